"""A data-skipping index of log files: what a report needs to know before it opens one.

One row per version of a file - its path, length and modification time - with the times of its events, its line counts
per split and the ids it opens with. A report joins its listing with the index: files whose last event lies before the range stay
closed, lines of the others are numbered without counting them again, and only files that are new or have changed are
read in full, once, and added. Rows of older versions match no listing and are never read for it.

Line numbers of an indexed file follow from its first marked line in each split, so splits may be cut anew; a split that the index
does not know makes the file count as changed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = ("file_path", "length", "mtime")
SCHEMA = (
    "file_path string, length bigint, mtime timestamp, lines bigint, splits array<struct<block: bigint, lines: bigint, marked: bigint>>, "
    "first_event timestamp, last_event timestamp, last_token timestamp, last_limit timestamp, first_id string, second_id string"
)
COLUMNS = ("file_path", "length", "mtime", "lines", "splits", "first_event", "last_event", "last_token", "last_limit", "first_id", "second_id")
# Paths of one read; more are read in several.
BATCH = 4096


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the index at `path`; none if there is no index yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def current(files: DataFrame, index: DataFrame) -> DataFrame:
    """The index rows of the listed files as they are now, with their `action`. Two reports may have added the same row."""
    rows = index.dropDuplicates(list(VERSION))
    return rows.join(files.select(*VERSION, "action"), list(VERSION))


def facts(files: DataFrame, splits: DataFrame, events: DataFrame, is_token: Column, is_limit: Column) -> DataFrame:
    """Index rows of files read in full, with their `action`, from their splits and the events of their marked lines."""
    number = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = events.groupBy("file_path", "block").agg(F.min("line_no").alias("head"))
    cut = splits.select("file_path", "block", "lines", F.coalesce(F.sum("lines").over(number), F.lit(0)).alias("offset"))
    cut = cut.join(heads, ["file_path", "block"], "left").withColumn("marked", F.col("head") - 1 - F.col("offset"))
    per_file = cut.groupBy("file_path").agg(
        F.sum("lines").alias("lines"), F.sort_array(F.collect_list(F.struct("block", "lines", "marked"))).alias("splits")
    )
    lead = lambda n: F.max(F.when((F.col("line_no") == n) & (F.col("event_type") == "session_meta"), F.col("meta_id")))
    last = lambda of, time: F.max_by(time, F.when(of & F.col(time).isNotNull(), F.col("line_no")))
    times = events.groupBy("file_path").agg(
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), last(is_token, "timestamp").alias("last_token"),
        last(is_limit, "sample_time").alias("last_limit"), lead(1).alias("first_id"), lead(2).alias("second_id"),
    )
    # An empty file has no splits.
    found = files.select(*VERSION, "action").join(per_file, "file_path", "left").join(times, "file_path", "left")
    empty = F.array().cast("array<struct<block:bigint,lines:bigint,marked:bigint>>")
    return found.withColumns({"lines": F.coalesce("lines", F.lit(0)), "splits": F.coalesce("splits", empty)})


def add(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).write.mode("append").parquet(path)


def stale(known: DataFrame, start, column: str) -> DataFrame:
    """Tail candidates whose last relevant event lies before the range."""
    return known.where(F.col("action").isin("tail", "tail_mtime") & (F.col(column) < F.lit(start))).select(
        "file_path", "action", F.col(column).alias("last_event")
    )


def split_info(marked_lines: DataFrame, known: DataFrame) -> DataFrame:
    """First row id and line offset of the splits that have marked lines; both null where the index does not know the split."""
    rows = marked_lines.groupBy("file_path", "block").agg(F.min("row").alias("row"))
    number = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = known.select("file_path", F.inline("splits")).withColumn("offset", F.coalesce(F.sum("lines").over(number), F.lit(0)))
    return rows.join(cut, ["file_path", "block"], "left").select("file_path", "block", (F.col("row") - F.col("marked")).alias("first_row"), "offset")


def batches(paths: DataFrame) -> Iterator[list[str]]:
    """The paths in lists of bounded length; they pass through the driver, like Spark's own listing."""
    held: list[str] = []
    for row in paths.toLocalIterator():
        held.append(row[0])
        if len(held) == BATCH:
            yield held
            held = []
    if held:
        yield held
