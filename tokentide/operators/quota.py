"""Logical quota windows, resets and the current state of each stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.scalars import window_id, within_jitter
from tokentide.operators.chunked import linked
from tokentide.operators.samples import SAMPLE_ORDER, active_samples

KEYS = ["stream"]


FIELDS = ("resets_at", "used_percent")


def is_reset() -> Column:
    """The sample is live, its reset moved beyond jitter from the previous one, and use went down."""
    return (
        (F.col("resets_at") > F.col("timestamp"))
        & ~within_jitter("prev.resets_at", "resets_at")
        & (F.col("used_percent") < F.col("prev.used_percent"))
    )


def transition_kind() -> Column:
    return (
        F.when(F.col("prev").isNull(), "firstObserved")
        .when(is_reset() & (F.col("timestamp") < F.col("prev.resets_at")), "early")
        .when(is_reset(), "normal")
        .when(F.col("prev.resets_at") != F.col("resets_at"), "changed")
        .otherwise("firstObserved")
    )


def transitions(samples: DataFrame) -> DataFrame:
    """Active samples with their predecessor in the stream (`prev`), the kind of step, and
    `run`: the logical window, which ends where the reset moves beyond jitter."""
    moved = lambda prev, cur: ~within_jitter(prev["resets_at"], cur["resets_at"])
    rows = linked(active_samples(samples), KEYS, "chunk", SAMPLE_ORDER, FIELDS, moved)
    return rows.withColumn("kind", transition_kind())


def quota_windows(samples: DataFrame) -> DataFrame:
    """Gaps-and-islands: one row per run of samples whose reset stays within jitter."""
    rows = transitions(samples)
    place = F.struct(*SAMPLE_ORDER)
    islands = rows.groupBy("stream", F.col("run").alias("island")).agg(
        F.min_by("window", place).alias("window"),
        F.max_by("resets_at", place).alias("reset_at"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min("used_percent").alias("min_used_percent"),
        F.max("used_percent").alias("max_used_percent"),
        F.max_by("used_percent", place).alias("last_used_percent"),
        F.count("*").alias("sample_count"),
        F.min_by("kind", place).alias("reset_kind"),
    )
    flat = islands.select("stream.*", *[c for c in islands.columns if c != "stream"])
    start = F.timestamp_micros(F.unix_micros("reset_at") - F.col("window_minutes") * 60_000_000)
    return flat.withColumn("estimated_start", start).withColumn(
        "id", window_id("window", "account_id", "plan_type", "limit_id", "reset_at")
    )


def order_windows(windows: DataFrame) -> DataFrame:
    return windows.orderBy(
        "reset_at", "first_seen", "window_minutes", *[F.asc_nulls_first(c) for c in ("account_id", "plan_type", "limit_id")]
    )


def quota_resets(samples: DataFrame, early_only: bool = False) -> DataFrame:
    rows = transitions(samples).where(F.col("prev").isNotNull() & is_reset())
    if early_only:
        rows = rows.where(F.col("kind") == "early")
    early = F.expr("(unix_micros(prev.resets_at) - unix_micros(timestamp)) div 1000000")
    return rows.select(
        F.col("timestamp").alias("at"),
        "account_id",
        "plan_type",
        "limit_id",
        "window",
        "window_minutes",
        F.col("prev.used_percent").alias("previous_used_percent"),
        F.col("used_percent").alias("next_used_percent"),
        F.col("prev.resets_at").alias("previous_resets_at"),
        F.col("resets_at").alias("next_resets_at"),
        F.greatest(early, F.lit(0)).alias("early_by_seconds"),
        "kind",
    )


def order_changes(changes: DataFrame) -> DataFrame:
    """Order of resets and trend changes."""
    return changes.orderBy(
        "at", "window_minutes", *[F.asc_nulls_first(c) for c in ("account_id", "plan_type", "limit_id")]
    )


def quota_current(samples: DataFrame, now) -> DataFrame:
    """The latest window of each (stream, label) first seen by `now`, and whether it still runs."""
    now = F.lit(now).cast("timestamp")
    windows = quota_windows(samples).where(F.col("first_seen") <= now)
    keys = ("window_minutes", "account_id", "plan_type", "limit_id", "window")
    rest = [c for c in windows.columns if c not in keys]
    # max_by instead of a ranking window: islands of one stream combine map-side.
    latest = (
        windows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("reset_at", "last_seen", "first_seen")).alias("w"))
        .select(*keys, "w.*")
    )
    active = F.col("reset_at") > now
    left = F.expr("(unix_micros(reset_at) - unix_micros(_now)) div 1000000")
    return (
        latest.withColumn("_now", now)
        .select(
            F.concat("id", F.lit("-current")).alias("id"),
            F.when(active, "active").otherwise("expired").alias("status"),
            "account_id",
            "plan_type",
            "limit_id",
            "window",
            "window_minutes",
            "last_seen",
            F.col("last_used_percent").alias("used_percent"),
            (F.lit(100.0) - F.col("last_used_percent")).alias("remaining_percent"),
            F.col("reset_at").alias("resets_at"),
            F.when(active, left).alias("reset_in_seconds"),
            "estimated_start",
        )
    )


def order_current(current: DataFrame) -> DataFrame:
    return current.orderBy(
        "window_minutes",
        *[F.asc_nulls_first(c) for c in ("account_id", "plan_type", "limit_id")],
        "status",
        "resets_at",
        "last_seen",
    )


def current_status(current: DataFrame) -> DataFrame:
    """`ok` when a window runs, `expired` when none does, `unobserved` without windows."""
    return current.agg(
        F.when(F.count("*") == 0, "unobserved")
        .when(F.count_if(F.col("status") == "active") > 0, "ok")
        .otherwise("expired")
        .alias("status")
    )


def row_status(rows: DataFrame) -> DataFrame:
    return rows.agg(F.when(F.count("*") == 0, "unobserved").otherwise("ok").alias("status"))


def unknown_limit_resets(resets: DataFrame) -> DataFrame:
    return resets.agg(F.count_if(F.col("limit_id").isNull()).alias("unknown_limit_reset_events"))


