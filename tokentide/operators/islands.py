"""Quota windows by increments: parts of a history are reduced on their own, and neighbouring parts are merged.

A part - a day, a file, a micro-batch - becomes one row per stream and run of samples whose reset stays within the jitter, with the run's
first and last sample. Two such rows that follow one another are one run if the reset of the last sample of the one and the
first of the other agree; sums, extremes and the latest reset combine. So merging is associative over parts in order of time, and a
history is kept as its merged rows: new samples only meet those.

Parts must not share instants: samples of one instant belong to one part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.scalars import window_id, within_jitter
from tokentide.operators.chunked import linked
from tokentide.operators.quota import transition_kind
from tokentide.operators.samples import SAMPLE_ORDER, _is_inactive, _rolling_zero, dedup_samples, with_stream

SAMPLE = (*SAMPLE_ORDER, "used_percent")


def window_parts(samples: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per stream, part and run: (stream, first, last, window, reset extremes and sums)."""
    rows = with_stream(dedup_samples(samples)).withColumn("part", F.lit(0) if part is None else part)
    # A part without a value is one of its own.
    rows = rows.withColumn("key", F.struct("stream", "part"))
    moved = lambda prev, cur: ~within_jitter(prev["resets_at"], cur["resets_at"])
    runs = linked(rows, ["key"], "chunk", SAMPLE_ORDER, ("resets_at", "used_percent"), moved)
    place, sample = F.struct(*SAMPLE_ORDER), F.struct(*SAMPLE)
    found = runs.groupBy("key", "run").agg(
        F.min_by(sample, place).alias("first"),
        F.max_by(sample, place).alias("last"),
        F.min_by("window", place).alias("window"),
        F.min("used_percent").alias("min_used_percent"),
        F.max("used_percent").alias("max_used_percent"),
        F.count("*").alias("sample_count"),
        F.min(_rolling_zero()).alias("idle"),
    )
    return found.select("key.stream", *[c for c in found.columns if c not in ("key", "run")])


def _linked_parts(parts: DataFrame) -> DataFrame:
    """Rows of all parts with the last sample before each (`prev`) and the number of the merged run."""
    order = Window.partitionBy("stream").orderBy("first")
    rows = parts.withColumn("prev", F.lag("last").over(order))
    joins = F.coalesce(within_jitter("prev.resets_at", "first.resets_at"), F.lit(False))
    return rows.withColumn("run", F.sum((~joins).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _merged(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("stream", "run").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("window", "first").alias("window"),
        F.min("min_used_percent").alias("min_used_percent"),
        F.max("max_used_percent").alias("max_used_percent"),
        F.sum("sample_count").alias("sample_count"),
        F.min("idle").alias("idle"),
        *more,
    )


def merge_parts(*parts: DataFrame) -> DataFrame:
    """The rows of several parts as those of one. Only rows of runs meet here, no samples."""
    return _merged(_linked_parts(reduce(DataFrame.unionByName, parts))).drop("run")


def windows_of(parts: DataFrame) -> DataFrame:
    """The quota windows of merged or unmerged parts, as `quota.quota_windows` gives them for their samples."""
    rows = _linked_parts(parts)
    kind = rows.select("*", "first.timestamp", "first.resets_at", "first.used_percent").withColumn("kind", transition_kind())
    whole = Window.partitionBy("stream")
    rows = _merged(kind, F.min_by("kind", "first").alias("reset_kind"))
    idle = _is_inactive(
        F.sum("sample_count").over(whole),
        F.min(F.unix_micros("first.timestamp")).over(whole),
        F.max(F.unix_micros("last.timestamp")).over(whole),
        F.min("idle").over(whole),
    )
    rows = rows.withColumn("inactive", idle).where("NOT inactive")
    flat = rows.select(
        "stream.*",
        F.col("run").alias("island"),
        "window",
        F.col("last.resets_at").alias("reset_at"),
        F.col("first.timestamp").alias("first_seen"),
        F.col("last.timestamp").alias("last_seen"),
        "min_used_percent",
        "max_used_percent",
        F.col("last.used_percent").alias("last_used_percent"),
        "sample_count",
        "reset_kind",
    )
    start = F.timestamp_micros(F.unix_micros("reset_at") - F.col("window_minutes") * 60_000_000)
    return flat.withColumn("estimated_start", start).withColumn(
        "id", window_id("window", "account_id", "plan_type", "limit_id", "reset_at")
    )
