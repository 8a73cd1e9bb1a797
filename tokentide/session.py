"""Session helpers: configuration, durable staging and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side with at most this many (narrow) rows may be broadcast.
MAX_BROADCAST_ROWS = 200_000
_SHIPPED: set[str] = set()


def build_session(app: str = "tokentide", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession, zone: str = "UTC") -> SparkSession:
    """Runtime settings every plan relies on."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    # A repeated JSON key must not turn a valid line into an invalid one.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers unless they find it on their path already."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if os.path.realpath(home) in known or spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="tokentide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tokentide"), "zip", home, "tokentide"))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's, or in local mode one of this process, deleted at its end."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="spark-tokentide-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def staging_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokentide-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Used where one expensive result feeds several consumers: the lineage ends in
    a durable table, so a lost executor re-reads files instead of re-parsing logs.
    `release` deletes what was staged.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete tables that `stage` has returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has staged; call it once their results are written or collected."""
    _delete(spark, staging_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Scope of one report: its staged tables are gone when the scope ends."""
    try:
        yield
    finally:
        release(spark)


def row_count_up_to(df: DataFrame, bound: int) -> int:
    """Exact row count when it is at most `bound`, else `bound + 1`."""
    return df.limit(bound + 1).count()


def broadcast_if_small(df: DataFrame, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to AQE."""
    return F.broadcast(df) if row_count_up_to(df, bound) <= bound else df
