"""Counters of a scan as one-row frames, and the warnings derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.sources.logs import Listing

SKIPS = ("missing_metadata", "missing_usage", "empty_usage", "out_of_range", "account_mismatch", "fork_replay")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames joined into one row."""
    out = rows[0].withColumn("_one", F.lit(1))
    for row in rows[1:]:
        out = out.join(row.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def file_counters(files: DataFrame, stale: DataFrame | None = None, listing: Listing | None = None) -> DataFrame:
    """What the listing kept and why; `stale` are tail candidates dropped by their last event.

    Folders that were opened or passed over while planning the `listing` count too; without a range it opens none itself.
    """
    is_ = lambda *a: F.count_if(F.col("action").isin(*a))
    folder = F.regexp_extract("relative", "^(.*)/", 1)
    counts = files.agg(
        is_("read", "tail", "tail_mtime").alias("candidate_files"),
        is_("skip_late", "skip_old").alias("skipped_files"),
        is_("tail", "tail_mtime").alias("tail_read_files"),
        is_("tail_mtime", "skip_old").alias("mtime_read_files"),
        is_("tail_mtime").alias("mtime_tail_hits"),
        F.count_distinct(F.when(F.col("action") != "skip_folder", folder)).alias("scanned_directories"),
        F.count_distinct(F.when(F.col("action") == "skip_folder", folder)).alias("skipped_directories"),
    )
    if listing is not None and listing.opened:
        # Folders that the readers opened are seen by the files below them.
        parts = F.split("relative", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        folders = files.where(F.size(parts) > 1).select("root", F.explode(above).alias("folder")).distinct()
        seen = folders.where(~F.col("folder").rlike("^[0-9]{4}(/[0-9]{2})?$")).agg(F.count("*").alias("deep"))
        counts = side_by_side(counts, seen).withColumns(
            {"scanned_directories": F.col("deep") + listing.opened, "skipped_directories": F.lit(listing.skipped).cast("long")}
        ).drop("deep")
    if stale is None:
        dropped = files.agg(F.lit(0).cast("long").alias("prefiltered_files"), F.lit(0).cast("long").alias("stale_mtime"))
    else:
        dropped = stale.agg(
            F.count("*").alias("prefiltered_files"), F.count_if(F.col("action") == "tail_mtime").alias("stale_mtime")
        )
    return (
        side_by_side(counts, dropped)
        .withColumn("read_files", F.col("candidate_files") - F.col("prefiltered_files"))
        .withColumn("tail_read_hits", F.col("tail_read_files") - F.col("prefiltered_files"))
        .withColumn("mtime_read_hits", F.col("mtime_tail_hits") - F.col("stale_mtime"))
        .drop("candidate_files", "stale_mtime")
    )


def usage_line_counters(events: DataFrame) -> DataFrame:
    """Invalid lines among those that pass the usage markers."""
    marked = F.col("has_token") | F.col("has_meta") | F.col("has_turn")
    return events.agg(F.count_if(marked & ~F.col("valid")).alias("invalid_json_lines"))


def skip_counters(token_events: DataFrame) -> DataFrame:
    return token_events.agg(
        F.count("*").alias("token_count_events"),
        F.count_if(F.col("skip_reason").isNull()).alias("included_usage_events"),
        *[F.count_if(F.col("skip_reason") == s).alias(s) for s in SKIPS],
    )


def sample_line_counters(events: DataFrame) -> DataFrame:
    """Parse counters of the limit events; `is_replay` must be attached."""
    live = ~F.col("is_replay")
    context = F.col("has_meta") | F.col("has_turn")
    dated = (F.col("limits") == "object") & F.col("sample_time").isNotNull()
    windows = F.when(dated & live, F.col("windows"))

    def entries(test) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(windows, test)).cast("long")), F.lit(0))

    accepted = F.size(F.filter("windows", lambda w: w["reject"].isNull()))
    no_window = (F.col("limits") == "other") | (dated & (accepted == 0))
    return events.agg(
        (
            F.count_if(live & context & ~F.col("valid")) + F.count_if(live & F.col("has_limits") & ~F.col("valid"))
        ).alias("invalid_json_lines"),
        F.count_if(live & F.col("limits").isin("null", "other", "object")).alias("rate_limit_events"),
        F.count_if(live & (F.col("limits") == "null")).alias("null_rate_limits"),
        F.count_if(live & (F.col("limits") == "missing")).alias("missing_rate_limits"),
        F.count_if(live & (F.col("limits") == "object") & F.col("sample_time").isNull()).alias("missing_timestamps"),
        F.count_if(live & no_window).alias("missing_windows"),
        entries(lambda w: w["unknown"]).alias("unknown_windows"),
        entries(lambda w: w["reject"] == "window_minutes").alias("invalid_window_minutes"),
        entries(lambda w: w["reject"] == "used_percent").alias("invalid_used_percent"),
        entries(lambda w: w["reject"] == "resets_at").alias("invalid_resets_at"),
        entries(lambda w: w["out_of_range"]).alias("out_of_range_percent"),
        F.count_if(F.col("is_replay") & (F.col("has_limits") | context)).alias("fork_replay_lines_skipped"),
    )


def limit_only_files(events: DataFrame) -> DataFrame:
    """Files with rate limits but not one token count."""
    per_file = events.groupBy("file_path").agg(
        F.max(F.col("has_limits") & ~F.col("is_replay")).alias("limits"), F.max("has_token").alias("tokens")
    )
    return per_file.agg(F.count_if(F.col("limits") & ~F.col("tokens")).alias("rate_limit_only_files"))


def sample_filter_counters(sample_events: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("skip_reason") == s)
    return sample_events.agg(
        F.count_if(F.col("skip_reason").isNull()).alias("included_samples"),
        is_("out_of_range").alias("out_of_range_samples"),
        is_("account_mismatch").alias("account_mismatches"),
        is_("plan_mismatch").alias("plan_mismatches"),
        is_("window_mismatch").alias("window_mismatches"),
    )


# Counters that raise a warning, in the order of the report.
WARNED = (
    ("prefiltered_files", "session file(s) were prefiltered and may hold usage in the range"),
    ("missing_metadata", "token event(s) skipped: missing metadata"),
    ("missing_usage", "token event(s) skipped: missing usage"),
    ("out_of_range", "token event(s) outside the time range"),
    ("account_mismatch", "token event(s) of another account"),
    ("fork_replay", "token event(s) replayed by a fork"),
    ("invalid_json_lines", "line(s) with invalid JSON"),
    ("unpriced_calls", "call(s) with an unpriced model"),
    ("unobserved_usage_events", "usage event(s) outside every observed window"),
)


def warnings(counters: DataFrame, full_scan: bool = False, unpriced: DataFrame | None = None) -> DataFrame:
    """One row per counter above zero: order, code, count, message. `unpriced` (model) names the models in theirs."""
    found = []
    names = F.lit("")
    if unpriced is not None:
        listed = unpriced.agg(F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("unpriced_names"))
        counters = counters.join(listed, how="left")
        names = F.when(F.col("unpriced_names") != "", F.concat(F.lit(": "), "unpriced_names")).otherwise("")
    for order, (name, text) in enumerate(WARNED):
        if name not in counters.columns or (name == "prefiltered_files" and full_scan):
            continue
        n = F.col(name).cast("long")
        row = F.struct(
            F.lit(order).alias("ord"),
            F.lit(name).alias("code"),
            n.alias("count"),
            F.concat(n.cast("string"), F.lit(" " + text), names if name == "unpriced_calls" else F.lit("")).alias("message"),
        )
        found.append(F.when(n > 0, row))
    return counters.select(F.inline(F.array_compact(F.array(*found)))).orderBy("ord")
