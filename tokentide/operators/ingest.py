"""Parsed events to usage records and quota samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.operators.asof import as_of
from tokentide.operators.chunked import carry_forward
from tokentide.operators.parse import explode_limits, rate_limits_of
from tokentide.schemas import TOKEN_FIELDS
from tokentide.sources.logs import path_session_id

SPLIT = ["file_path"]


def with_forks(events: DataFrame, forks: DataFrame | None) -> DataFrame:
    """Adds `pinned_id` and `is_replay`. Fork facts travel per file split, so a huge file stays spread."""
    if forks is None:
        return events.withColumns({"pinned_id": F.lit(None).cast("string"), "is_replay": F.lit(False)})
    facts = forks.select("file_path", "pinned_id", "replay_prefix_lines")
    blocks = events.select("file_path", "block").distinct().join(facts, "file_path", "left")
    replay = (F.col("line_no") > 1) & (F.col("line_no") <= F.coalesce("replay_prefix_lines", F.lit(0)))
    return events.join(blocks, ["file_path", "block"]).withColumn("is_replay", replay).drop("replay_prefix_lines")


def _path_id() -> Column:
    return path_session_id(F.element_at(F.split("file_path", "/"), -1), F.col("file_path"))


def is_token_event() -> Column:
    return F.coalesce((F.col("event_type") == "event_msg") & (F.col("payload_type") == "token_count"), F.lit(False))


def carried(events: DataFrame) -> DataFrame:
    """Session id, model, effort and cwd in force at each usage line, and the counters before it.

    Context lines a fork replayed do not count, replayed counters do.
    """
    lines = events.where(F.col("has_token") | F.col("has_meta") | F.col("has_turn"))
    meta = (F.col("event_type") == "session_meta") & ~F.col("is_replay")
    context = F.col("event_type").isin("session_meta", "turn_context") & ~F.col("is_replay")
    rows = carry_forward(
        lines,
        SPLIT,
        "block",
        ["line_no"],
        inclusive={
            "last_id": F.when(meta, F.col("meta_id")),
            "model": F.when(context, F.col("meta_model")),
            "reasoning_effort": F.when(context, F.col("meta_effort")),
            "cwd": F.when(context, F.col("meta_cwd")),
        },
        before={"previous_total": F.when(is_token_event() & F.col("has_info"), F.col("total_usage"))},
    )
    return rows.withColumns(
        {
            "session_id": F.coalesce("pinned_id", "last_id", _path_id()),
            "model": F.coalesce("model", F.lit("unknown")),
            "cwd": F.coalesce("cwd", F.lit("unknown")),
        }
    ).drop("last_id")


def counter_diff(total: str = "total_usage", previous: str = "previous_total", last: str = "last_usage") -> Column:
    """Growth of the cumulative counters, never negative; without counters the line's own usage."""
    grown = F.struct(
        *[F.greatest(F.col(f"{total}.{f}") - F.col(f"{previous}.{f}"), F.lit(0)).alias(f) for f in TOKEN_FIELDS]
    )
    return F.when(F.col(total).isNull(), F.col(last)).when(F.col(previous).isNull(), F.col(total)).otherwise(grown)


def skip_reason(start, end, account_id: str | None) -> Column:
    """Why a token event is no usage record; the first reason counts, null means included."""
    usage = F.col("usage")
    empty = F.lit(True)
    for f in TOKEN_FIELDS:
        empty = empty & (usage[f] == 0)
    reason = (
        F.when(F.col("is_replay"), "fork_replay")
        .when(~F.col("has_info") | F.col("timestamp").isNull(), "missing_metadata")
        .when(usage.isNull(), "missing_usage")
        .when(empty, "empty_usage")
    )
    if start is not None:
        reason = reason.when(F.col("timestamp") < F.lit(start), "out_of_range")
    if end is not None:
        reason = reason.when(F.col("timestamp") > F.lit(end), "out_of_range")
    if account_id is not None:
        reason = reason.when(~F.col("account_id").eqNullSafe(F.lit(account_id)), "account_mismatch")
    return reason


def attributed(df: DataFrame, ts: str, history, value: str, out: str | None = None) -> DataFrame:
    """As-of lookup in an optional history (switches, default)."""
    if history is None:
        kind = "boolean" if value == "fast" else "string"
        return df.withColumn(out or value, F.lit(None).cast(kind))
    switches, default = history
    return as_of(df, ts, switches, value, default, out)


def token_events(
    events: DataFrame, forks: DataFrame | None = None, accounts=None, modes=None, start=None, end=None, account_id: str | None = None
) -> DataFrame:
    """Every token-count event as a would-be record with its `skip_reason`."""
    rows = carried(with_forks(events, forks)).where(is_token_event()).withColumn("usage", counter_diff())
    rows = attributed(attributed(rows, "timestamp", accounts, "account_id"), "timestamp", modes, "fast")
    return rows.select(
        "timestamp",
        "session_id",
        "model",
        "fast",
        "reasoning_effort",
        "cwd",
        "account_id",
        "file_path",
        "line_no",
        rate_limits_of(F.when(F.col("sample_time").isNotNull(), F.col("windows")), F.col("plan_type"), F.col("limit_id")).alias("rate_limits"),
        *[F.col(f"usage.{f}").alias(f) for f in TOKEN_FIELDS],
        skip_reason(start, end, account_id).alias("skip_reason"),
    )


def usage_records(*args, **kwargs) -> DataFrame:
    """Included token events; arguments as for `token_events`."""
    return token_events(*args, **kwargs).where(F.col("skip_reason").isNull()).drop("skip_reason")


def sample_events(
    events: DataFrame,
    forks: DataFrame | None = None,
    accounts=None,
    start=None,
    end=None,
    account_id: str | None = None,
    plan_type: str | None = None,
    window_minutes: int | None = None,
) -> DataFrame:
    """Every parsed quota sample with the `skip_reason` of the filters, first match wins."""
    lines = with_forks(events, forks).where(F.col("has_limits") | F.col("has_meta") | F.col("has_turn"))
    meta = (F.col("event_type") == "session_meta") & ~F.col("is_replay")
    trimmed = F.regexp_replace("meta_id", r"^\s+|\s+$", "")
    rows = carry_forward(lines, SPLIT, "block", ["line_no"], inclusive={"last_id": F.when(meta, trimmed)})
    rows = rows.where(~F.col("is_replay")).withColumn("session_id", F.coalesce("pinned_id", "last_id", _path_id()))
    rows = attributed(explode_limits(rows), "timestamp", accounts, "account_id")
    tests = [
        ("out_of_range", None if start is None else F.col("timestamp") < F.lit(start)),
        ("out_of_range", None if end is None else F.col("timestamp") > F.lit(end)),
        ("account_mismatch", None if account_id is None else ~F.col("account_id").eqNullSafe(F.lit(account_id))),
        ("plan_mismatch", None if plan_type is None else ~F.col("plan_type").eqNullSafe(F.lit(plan_type))),
        ("window_mismatch", None if window_minutes is None else F.col("window_minutes") != window_minutes),
    ]
    reason = F.lit(None).cast("string")
    for name, test in reversed(tests):
        if test is not None:
            reason = F.when(test, name).otherwise(reason)
    return rows.select(
        "timestamp",
        "session_id",
        "account_id",
        "plan_type",
        "limit_id",
        "window",
        "window_minutes",
        "used_percent",
        "remaining_percent",
        "resets_at",
        F.col("file_path").alias("source_path"),
        F.col("line_no").alias("source_line"),
        reason.alias("skip_reason"),
    )


def quota_samples(*args, **kwargs) -> DataFrame:
    """Samples that pass every filter; arguments as for `sample_events`."""
    return sample_events(*args, **kwargs).where(F.col("skip_reason").isNull()).drop("skip_reason")


def without_evidence(samples: DataFrame) -> DataFrame:
    """The public projection: where a sample came from is shown on request only."""
    return samples.drop("source_path", "source_line")


def stale_files(events: DataFrame, files: DataFrame, start, relevant: Column, time: str = "timestamp") -> DataFrame:
    """Files listed as `tail` candidates whose last relevant event lies before the range."""
    last = (
        events.where(relevant & F.col(time).isNotNull()).groupBy("file_path").agg(F.max_by(time, "line_no").alias("last_event"))
    )
    tails = files.where(F.col("action").isin("tail", "tail_mtime")).select("file_path", "action")
    return tails.join(last, "file_path").where(F.col("last_event") < F.lit(start))


def drop_files(events: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Events of the other files, matched per file split."""
    blocks = events.select("file_path", "block").distinct().join(unwanted.select("file_path"), "file_path", "left_semi")
    return events.join(blocks, ["file_path", "block"], "left_anti")
