"""Detector of unusually fast quota use.

Percent growth between consecutive 5-hour samples is split over the sessions active
in between by their share of credits, summed per session and quota window, and
compared with the cheapest segment of the same stream.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.scalars import FIVE_HOURS, PERCENT_EPSILON, off_time, round6, round_metric
from tokentide.operators.chunked import linked, time_chunk
from tokentide.operators.intervals import RECORD, covering, exact_matches
from tokentide.session import stage

MIN_CALLS = 3
MIN_DELTA = 1.0
MIN_MULTIPLIER = 1.5
EXPECTED_SHARE = 0.65
STREAM = ("account_id", "plan_type", "limit_id")
SEGMENT = (*STREAM, "session_id", "resets_at")

# Reasons a segment (or an interval) ends with.
NO_SAMPLES = "noFiveHourSamples"
NO_USAGE = "noUsageInSegment"
NO_RISE = "noRisingUsageInSegment"
SMALL_STEP = "minimumPercentStep"
FEW_CALLS = "tooFewUsageCallsInSegment"
NO_PRICED = "noPricedUsageInSegment"
NO_FAST_MODEL = "noFastMultiplierModel"
NO_BASELINE = "insufficientBaseline"
NORMAL = "normalMultiplier"
MIXED = "mixedModelsWeightedExpectedMultiplier"
EXPECTED = "matchesExpectedFastMultiplier"


def observations(samples: DataFrame) -> DataFrame:
    """Highest use per (stream, reset, time) among 5-hour samples, one sample per session."""
    key = (*STREAM, "timestamp", "resets_at")
    return (
        samples.where(F.col("window_minutes") == FIVE_HOURS)
        .groupBy(*key, "session_id")
        .agg(F.min_by("used_percent", F.struct("source_path", "source_line")).alias("used"), F.count("*").alias("n"))
        .groupBy(*key)
        .agg(F.max("used").alias("used_percent"), F.sum("n").alias("samples"))
    )


def sample_pairs(observed: DataFrame) -> DataFrame:
    """Consecutive observations of each (stream, reset), with their counters' flags."""
    rows = observed.withColumns(
        {"key": F.struct(*STREAM, "resets_at"), "chunk": time_chunk("timestamp")}
    )
    pairs = linked(rows, ["key"], "chunk", ["timestamp"], ["timestamp", "used_percent"]).where("prev IS NOT NULL")
    active = (F.col("resets_at") > F.col("timestamp")) & (F.col("resets_at") > F.col("prev.timestamp"))
    delta = F.col("used_percent") - F.col("prev.used_percent")
    return pairs.select(
        *STREAM,
        "resets_at",
        F.col("prev.timestamp").alias("interval_start"),
        F.col("timestamp").alias("interval_end"),
        F.greatest(delta, F.lit(0.0)).alias("delta_used_percent"),
        active.alias("active"),
        (active & (delta > PERCENT_EPSILON)).alias("rising"),
        (active & (delta >= -PERCENT_EPSILON)).alias("usable"),
    )


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that can take usage, numbered in no order."""
    return stage(pairs.where(F.col("usable")).withColumn("target_no", F.monotonically_increasing_id()), "usable")


def usage_matches(usable: DataFrame, priced: DataFrame) -> DataFrame:
    """(record, pair) matches, plus one row per record that found only ambiguous pairs (`kind` ambiguous, no pair).

    With rate limits only exact pairs count. Without, a record needs a pair that is
    alone within (account, plan).
    """
    targets = usable.select(
        "target_no",
        F.col("interval_start").alias("start"),
        F.col("interval_end").alias("end"),
        *STREAM,
        F.lit(FIVE_HOURS).cast("long").alias("window_minutes"),
        F.col("resets_at").alias("reset_at"),
    )
    carry = ["session_id", "model", "total_tokens", "normal_credits", "fast_credits"]
    columns = [*RECORD, "target_no", "kind", *carry]
    exact = exact_matches(priced, targets, carry, "right").withColumn("kind", F.lit("exact"))
    groups = covering(priced.where(F.size("rate_limits") == 0), targets, carry, ["t_plan"], "right")
    alone = groups.where("n = 1").withColumn("kind", F.lit("legacy"))
    several = (
        groups.groupBy(*RECORD)
        .agg(F.min("n").alias("least"), *[F.first(c).alias(c) for c in carry])
        .where("least > 1")
        .withColumns({"kind": F.lit("ambiguous"), "target_no": F.lit(None).cast("long")})
    )
    return exact.select(columns).unionByName(alone.select(columns)).unionByName(several.select(columns))


def intervals(usable: DataFrame, matches: DataFrame) -> DataFrame:
    """Each pair's growth split over its sessions by credits, or by calls when nothing was priced."""
    per_session = (
        matches.where(F.col("kind") != "ambiguous")
        .groupBy("target_no", "session_id")
        .agg(F.sum("normal_credits").alias("w"), F.count("*").alias("calls"))
    )
    totals = per_session.groupBy("target_no").agg(F.sum("w").alias("all_w"), F.sum("calls").alias("all_calls"))
    share = F.when(
        F.col("all_w") <= Decimal("0.000001"), F.col("calls").cast("double") / F.col("all_calls").cast("double")
    ).otherwise(F.col("w").cast("double") / F.col("all_w").cast("double"))
    return (
        per_session.join(totals, "target_no")
        .join(usable, "target_no")
        .select(
            *STREAM,
            "session_id",
            "resets_at",
            "interval_start",
            "interval_end",
            # Decimal, so that later sums do not depend on their order.
            (F.col("delta_used_percent") * share).cast("decimal(28,12)").alias("delta_used_percent"),
            "calls",
        )
    )


def segments(split: DataFrame, matches: DataFrame, usable: DataFrame) -> DataFrame:
    """Intervals summed per (stream, session, reset), with a summary of their usage."""
    spans = split.groupBy(*SEGMENT).agg(
        F.min("interval_start").alias("segment_start"),
        F.max("interval_end").alias("segment_end"),
        F.sum("delta_used_percent").alias("delta_used_percent"),
        F.count("*").alias("sample_pairs"),
    )
    expected = F.when(F.col("normal_credits") > Decimal("0.000001"), F.col("fast_credits")).otherwise(F.col("normal_credits"))
    per_model = (
        matches.where(F.col("kind") != "ambiguous")
        .join(usable.select("target_no", *STREAM, "resets_at"), "target_no")
        .withColumn("expected", expected)
        .groupBy(*SEGMENT, "model")
        .agg(
            F.count("*").alias("calls"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("normal_credits").alias("normal_credits"),
            F.sum("expected").alias("expected"),
            F.min("file_path").alias("first_path"),
            F.max("file_path").alias("last_path"),
        )
    )
    summary = per_model.groupBy(*SEGMENT).agg(
        F.sum("calls").alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("normal_credits").alias("normal_credits"),
        F.sum("expected").alias("expected"),
        F.min_by("model", F.struct(-F.col("normal_credits"), -F.col("calls"), F.col("model"))).alias("model"),
        (F.count("*") > 1).alias("mixed"),
        F.when(F.min("first_path") == F.max("last_path"), F.min("first_path")).otherwise("mixed").alias("file_path"),
    )
    same = [spans[c].eqNullSafe(summary[c]) for c in SEGMENT]
    return spans.join(summary, same).select(spans["*"], *[summary[c] for c in summary.columns if c not in SEGMENT])


def _reason() -> Column:
    return (
        F.when(F.col("delta") <= PERCENT_EPSILON, NO_RISE)
        .when(F.col("delta") <= MIN_DELTA + PERCENT_EPSILON, SMALL_STEP)
        .when(F.col("calls") < MIN_CALLS, FEW_CALLS)
        .when(F.col("normal") <= PERCENT_EPSILON, NO_PRICED)
        .when(F.col("expected_fast_multiplier") <= 1.0 + PERCENT_EPSILON, NO_FAST_MODEL)
    )


def confidence(effective: Column | str, expected: Column | str) -> Column:
    effective = F.col(effective) if isinstance(effective, str) else effective
    expected = F.col(expected) if isinstance(expected, str) else expected
    distance = F.abs(effective - expected)
    return (
        F.when((effective < MIN_MULTIPLIER) | (effective < expected * EXPECTED_SHARE), "insufficient")
        .when(distance <= 0.25, "high")
        .when(distance <= 0.5, "medium")
        .otherwise("low")
    )


def score(segs: DataFrame) -> DataFrame:
    """Every segment with the reason it ends with, its multipliers and its confidence."""
    normal = F.col("normal_credits").cast("double")
    rows = (
        segs.withColumn("delta", F.col("delta_used_percent").cast("double"))
        .withColumn("normal", normal)
        .withColumn(
            "expected_fast_multiplier",
            F.when(normal <= PERCENT_EPSILON, 1.0).otherwise(F.col("expected").cast("double") / normal),
        )
        .withColumn("reject", _reason())
        .withColumn("percent_per_credit", F.when(F.col("reject").isNull(), F.col("delta") / normal))
    )
    # A groupBy and a join, not a window: a hot stream's segments combine map-side.
    base = (
        rows.where(F.col("reject").isNull())
        .groupBy(F.struct(*STREAM).alias("stream"))
        .agg(F.count("*").alias("scored"), F.greatest(F.min("percent_per_credit"), F.lit(PERCENT_EPSILON)).alias("baseline"))
    )
    rows = rows.withColumn("stream", F.struct(*STREAM)).join(base, "stream", "left").drop("stream")
    effective = F.when(F.col("reject").isNull() & (F.col("scored") >= 2), F.col("percent_per_credit") / F.col("baseline"))
    rows = rows.withColumn("effective_multiplier", effective).withColumn(
        "confidence",
        F.when(effective.isNull(), "insufficient").otherwise(confidence(effective, "expected_fast_multiplier")),
    )
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("scored") < 2, NO_BASELINE)
        .when(F.col("confidence") == "insufficient", NORMAL)
        .when(F.col("mixed"), MIXED)
        .otherwise(EXPECTED)
    )
    return rows.withColumn("reason", reason)


def candidate_rows(scored: DataFrame) -> DataFrame:
    hits = scored.where(F.col("reason").isin(MIXED, EXPECTED))
    return hits.select(
        F.col("segment_end").alias("timestamp"),
        "segment_start",
        "segment_end",
        off_time("segment_end").alias("suggested_off_at"),
        "session_id",
        "model",
        "file_path",
        *STREAM,
        "resets_at",
        "sample_pairs",
        "calls",
        "total_tokens",
        round_metric("delta").alias("delta_used_percent"),
        round6("normal_credits").alias("normal_credits"),
        round_metric("percent_per_credit").alias("percent_per_credit"),
        round_metric("baseline").alias("baseline_percent_per_credit"),
        round_metric("effective_multiplier").alias("effective_multiplier"),
        round_metric("expected_fast_multiplier").alias("expected_fast_multiplier"),
        "confidence",
        "reason",
    ).orderBy("timestamp", *[F.asc_nulls_first(c) for c in STREAM], "model")


class Detection:
    """The detector's steps over one set of samples and priced usage; shared steps are staged once."""

    def __init__(self, samples: DataFrame, priced: DataFrame):
        self.observed = stage(observations(samples), "observations")
        self.pairs = stage(sample_pairs(self.observed), "pairs")
        self.usable = usable_pairs(self.pairs)
        self.matches = stage(usage_matches(self.usable, priced), "matches")
        self.intervals = intervals(self.usable, self.matches)
        self.segments = segments(self.intervals, self.matches, self.usable)
        self.scored = score(self.segments)

    def candidates(self) -> DataFrame:
        return candidate_rows(self.scored)

    def reasons(self) -> DataFrame:
        """How often each reason occurred, pairs that rose without any usage included."""
        used = self.matches.where(F.col("kind") != "ambiguous").select("target_no").distinct()
        idle = self.usable.where(F.col("rising")).join(used, "target_no", "left_anti")
        empty = self.observed.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(NO_SAMPLES).alias("reason"))
        return (
            self.scored.select("reason")
            .unionByName(idle.select(F.lit(NO_USAGE).alias("reason")))
            .unionByName(empty)
            .groupBy("reason")
            .agg(F.count("*").alias("count"))
            .orderBy("reason")
        )

    def counters(self) -> DataFrame:
        """The detector's counters as one row."""
        is_ = lambda r: F.col("reason") == r
        short = F.col("reason").isin(NO_RISE, SMALL_STEP, FEW_CALLS, NO_BASELINE)
        parts = [
            self.observed.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("five_hour_samples")),
            self.pairs.agg(
                F.count("*").alias("sample_pairs"),
                F.count_if("active").alias("active_sample_pairs"),
                F.count_if("rising").alias("rising_sample_pairs"),
            ),
            self.matches.agg(
                F.count_if(F.col("kind") == "exact").alias("exact_usage_matches"),
                F.count_if(F.col("kind") == "legacy").alias("legacy_usage_matches"),
                F.count_if(F.col("kind") == "ambiguous").alias("ambiguous_legacy_usage_records"),
            ),
            self.scored.agg(
                F.count("*").alias("segments_with_usage"),
                F.count_if(is_(MIXED) | is_(EXPECTED)).alias("candidate_segments"),
                F.count_if(is_(NORMAL)).alias("normal_segments"),
                F.count_if(short).alias("insufficient_segments"),
                F.count_if(F.col("reject").isNull() & F.col("mixed")).alias("mixed_model_segments"),
            ),
        ]
        row = parts[0].withColumn("one", F.lit(1))
        for part in parts[1:]:
            row = row.join(part.withColumn("one", F.lit(1)), "one")
        return row.drop("one").withColumn("no_five_hour_samples", F.col("five_hour_samples") == 0)
