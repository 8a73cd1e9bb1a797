"""Account and mode histories: reading, normalising, appending, status."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions.variants import RFC3339
from tokentide.operators.asof import as_of
from tokentide.schemas import ACCOUNT_HISTORY, ACCOUNT_SWITCHES, MODE_HISTORY, MODE_SWITCHES

VERSION = 1

# Where a switch may have come from.
SELECT_SOURCE = "auth select"
REMOVE_SOURCE = "auth remove"
DEFAULT_ACCOUNT_SOURCE = "auth.json"
FAST_ON_SOURCES = ("fast on", "mode fast on")
FAST_OFF_SOURCES = ("fast off", "mode fast off")
MANUAL_SOURCE = "manual file edit"


def _fail_if(bad: Column, message: str, value: Column) -> Column:
    """`value`, or an error at run time when `bad` holds."""
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(message)).cast("string")).otherwise(value.cast("string"))


def _time(text: Column, what: str) -> Column:
    return _fail_if(~text.rlike(RFC3339), f"{what} must be a date string", text).cast("timestamp")


def _id(text: Column, what: str) -> Column:
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    return _fail_if(clean == "", f"{what} cannot be empty", clean)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The history file; None when it is missing or blank."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    text = text.where(F.col("value").rlike(r"\S"))
    if text.isEmpty():
        return None
    doc = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    version = doc.first()["version"]
    if version != VERSION:
        raise ValueError(f"unsupported history version {version} in {path}")
    return doc


def normalize_accounts(switches: DataFrame) -> DataFrame:
    """Validated account switches; `pos` ranks equal times by (to, from)."""
    source = F.col("source")
    good = source.isin(SELECT_SOURCE, REMOVE_SOURCE)
    return switches.select(
        _time(F.col("timestamp"), "switch.timestamp").alias("ts"),
        _id(F.col("to_account_id"), "switch to account id").alias("account_id"),
        _id(F.col("from_account_id"), "switch from account id").alias("from_account_id"),
        _fail_if(~good, "switch.source must be auth select or auth remove", source).alias("source"),
    ).withColumn("pos", F.struct("account_id", "from_account_id"))


def normalize_modes(switches: DataFrame) -> DataFrame:
    """Validated mode switches; input order (`pos`) ranks equal times."""
    return switches.select(
        _time(F.col("timestamp"), "switch.timestamp").alias("ts"),
        "fast",
        _fail_if(~_mode_source_ok(F.col("source"), F.col("fast")), "switch.source must match its fast value", F.col("source")).alias("source"),
        "pos",
    )


def _mode_source_ok(source: Column, fast: Column) -> Column:
    return (
        (source.isin(*FAST_ON_SOURCES) & fast) | (source.isin(*FAST_OFF_SOURCES) & ~fast) | (source == MANUAL_SOURCE)
    )


def attribution(switches: DataFrame) -> DataFrame:
    """Account switches that change attribution: removals do not."""
    return switches.where(F.col("source") == SELECT_SOURCE)


def load_accounts(spark: SparkSession, path: str) -> tuple[DataFrame, str | None] | None:
    """(all switches, default account), or None without any history."""
    doc = _document(spark, path, ACCOUNT_HISTORY)
    if doc is None:
        return None
    s = F.col("s")
    switches = normalize_accounts(
        doc.select(F.explode("switches").alias("s")).select(
            s["timestamp"].alias("timestamp"),
            s["fromAccountId"].alias("from_account_id"),
            s["toAccountId"].alias("to_account_id"),
            s["source"].alias("source"),
        )
    )
    head = doc.where(F.col("defaultAccount").isNotNull()).select(
        _id(F.col("defaultAccount.accountId"), "default account id").alias("id"),
        _time(F.col("defaultAccount.observedAt"), "defaultAccount.observedAt").alias("at"),
        _fail_if(
            F.col("defaultAccount.source") != DEFAULT_ACCOUNT_SOURCE,
            f"defaultAccount.source must be {DEFAULT_ACCOUNT_SOURCE}",
            F.col("defaultAccount.source"),
        ).alias("source"),
    ).first()
    if head is None and switches.isEmpty():
        return None
    return switches, (head["id"] if head else None)


def load_modes(spark: SparkSession, path: str) -> tuple[DataFrame, bool | None] | None:
    """(switches, default mode), or None without any history."""
    doc = _document(spark, path, MODE_HISTORY)
    if doc is None:
        return None
    s = F.col("s")
    switches = normalize_modes(
        doc.select(F.posexplode("switches").alias("pos", "s")).select(
            s["timestamp"].alias("timestamp"), s["fast"].alias("fast"), s["source"].alias("source"), F.col("pos").cast("long").alias("pos")
        )
    )
    default = F.col("defaultMode")
    head = doc.where(default.isNotNull()).select(
        _time(default["observedAt"], "defaultMode.observedAt").alias("at"),
        _fail_if(~_mode_source_ok(default["source"], default["fast"]), "defaultMode.source must match its fast value", default["fast"]).cast("boolean").alias("fast"),
    ).first()
    if head is None and switches.isEmpty():
        return None
    return switches, (head["fast"] if head else None)


def account_attribution(history: tuple[DataFrame, str | None] | None):
    """A loaded account history in the shape the as-of lookup takes."""
    return None if history is None else (attribution(history[0]), history[1])


def ensure_default(history: tuple[DataFrame, str | None] | None, spark: SparkSession, account_id: str):
    """The history with a default account, kept if it already has one."""
    if history is None:
        empty = spark.createDataFrame([], ACCOUNT_SWITCHES).withColumn("pos", F.struct("account_id", "from_account_id"))
        return empty, account_id
    return history[0], history[1] or account_id


def append_mode(switches: DataFrame, fast: bool, ts) -> DataFrame:
    """The switches plus a new one, which wins among equal times."""
    source = FAST_ON_SOURCES[0] if fast else FAST_OFF_SOURCES[0]
    new = switches.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos")).select(
        F.lit(ts).cast("timestamp").alias("ts"), F.lit(fast).alias("fast"), F.lit(source).alias("source"), "pos"
    )
    return switches.select("ts", "fast", "source", "pos").unionByName(new)


def append_account(switches: DataFrame, from_account_id: str, to_account_id: str, ts) -> DataFrame:
    new = switches.sparkSession.range(1).select(
        F.lit(ts).cast("timestamp").alias("ts"),
        F.lit(to_account_id).alias("account_id"),
        F.lit(from_account_id).alias("from_account_id"),
        F.lit(SELECT_SOURCE).alias("source"),
    ).withColumn("pos", F.struct("account_id", "from_account_id"))
    return switches.unionByName(new)


def ordered(switches: DataFrame) -> DataFrame:
    return switches.orderBy("ts", "pos")


def mode_status(switches: DataFrame, now, default: bool | None = None) -> DataFrame:
    """State as of `now`, the latest switch and how many there are."""
    latest = switches.agg(
        F.count("*").alias("switch_count"),
        F.max("ts").alias("latest_switch_at"),
        F.max_by("fast", F.struct("ts", "pos")).alias("latest_switch_fast"),
    ).withColumn("as_of", F.lit(now).cast("timestamp"))
    status = as_of(latest, "as_of", switches, "fast", default)
    label = F.when(F.col("fast").isNull(), "unknown").when(F.col("fast"), "on").otherwise("off")
    return status.withColumn("state", label)
