"""Quota samples: deduplication, inactive streams, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.scalars import JITTER_MICROS, PERCENT_EPSILON
from tokentide.operators.chunked import time_chunk
from tokentide.session import stage

STREAM_FIELDS = ("account_id", "plan_type", "limit_id", "window_minutes")
SAMPLE_ORDER = ("timestamp", "resets_at", "session_id")
INACTIVE_MIN_SAMPLES = 3
INACTIVE_MIN_SECONDS = 60


def stream() -> Column:
    """The quota stream as one non-null struct, so nullable ids group and join as equal."""
    return F.struct(*STREAM_FIELDS).alias("stream")


def with_stream(df: DataFrame) -> DataFrame:
    return df.withColumn("stream", stream()).withColumn("chunk", time_chunk("timestamp"))


def filter_samples(
    samples: DataFrame,
    start=None,
    end=None,
    account_id: str | None = None,
    plan_type: str | None = None,
    window_minutes: int | None = None,
) -> DataFrame:
    """Inclusive time range and equality filters; a null never matches."""
    for condition in (
        None if start is None else F.col("timestamp") >= F.lit(start),
        None if end is None else F.col("timestamp") <= F.lit(end),
        None if account_id is None else F.col("account_id") == account_id,
        None if plan_type is None else F.col("plan_type") == plan_type,
        None if window_minutes is None else F.col("window_minutes") == window_minutes,
    ):
        if condition is not None:
            samples = samples.where(condition)
    return samples


def order_samples(samples: DataFrame) -> DataFrame:
    return samples.orderBy("timestamp", "session_id", "window_minutes", F.asc_nulls_first("limit_id"))


def dedup_samples(samples: DataFrame) -> DataFrame:
    """One sample per (stream, timestamp, resets_at), that of the lowest session id; `copies` counts all.

    The aggregate has one value per instant, so copies collapse map-side and a
    chunk of a stream holds at most one row per distinct (time, reset).
    """
    rest = [c for c in samples.columns if c not in (*STREAM_FIELDS, "timestamp", "resets_at")]
    first = F.min_by(F.struct(*rest), F.struct("session_id", "source_path", "source_line"))
    return (
        samples.groupBy(*STREAM_FIELDS, "timestamp", "resets_at")
        .agg(first.alias("_s"), F.count("*").alias("copies"))
        .select(*[f"_s.{c}" if c in rest else c for c in samples.columns], "copies")
    )


def _rolling_zero() -> Column:
    full = F.unix_micros("timestamp") + F.col("window_minutes") * 60_000_000
    return (F.abs("used_percent") <= PERCENT_EPSILON) & (F.abs(full - F.unix_micros("resets_at")) < JITTER_MICROS)


def _activity(deduped: DataFrame, *keys: str) -> DataFrame:
    return deduped.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(F.unix_micros("timestamp")).alias("lo"),
        F.max(F.unix_micros("timestamp")).alias("hi"),
        F.min(_rolling_zero()).alias("idle"),
    )


def _is_inactive(n: Column, lo: Column, hi: Column, idle: Column) -> Column:
    return (n >= INACTIVE_MIN_SAMPLES) & (hi - lo >= INACTIVE_MIN_SECONDS * 1_000_000) & idle


def inactive_streams(samples: DataFrame) -> DataFrame:
    """Streams that only ever report zero use with a reset rolling a full window ahead."""
    got = _activity(with_stream(dedup_samples(samples)), "stream")
    test = _is_inactive(F.col("n"), F.col("lo"), F.col("hi"), F.col("idle"))
    return got.where(test).select("stream.*", F.col("n").alias("samples"))


def active_samples(samples: DataFrame, keep_inactive_flag: bool = False) -> DataFrame:
    """Deduplicated samples of streams that are not inactive, with `stream` and `chunk`.

    Whether a stream is inactive is decided on per-chunk summaries and joined back
    per (stream, chunk), so a hot stream is never gathered on one task.
    """
    rows = stage(with_stream(dedup_samples(samples)), "samples")
    whole = Window.partitionBy("stream")
    flags = _activity(rows, "stream", "chunk").select(
        "stream",
        "chunk",
        _is_inactive(
            F.sum("n").over(whole), F.min("lo").over(whole), F.max("hi").over(whole), F.min("idle").over(whole)
        ).alias("inactive"),
    )
    joined = rows.join(flags, ["stream", "chunk"])
    return joined if keep_inactive_flag else joined.where(~F.col("inactive")).drop("inactive")


def sample_counters(samples: DataFrame) -> DataFrame:
    """Report counters: samples, duplicates, ignored inactive, unknown limits, status."""
    flagged = active_samples(samples, keep_inactive_flag=True)
    return flagged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_samples"),
        F.count_if(F.col("inactive")).alias("ignored_inactive_stream_samples"),
        F.coalesce(F.sum(F.when(F.col("limit_id").isNull(), F.col("copies"))), F.lit(0)).alias("unknown_limit_samples"),
        F.when(F.count("*") == 0, "unobserved").otherwise("ok").alias("status"),
    )
