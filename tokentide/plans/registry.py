"""Every operator as a named query over the given tables.

Timestamps leave as microseconds since the epoch, so results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentide.functions.scalars import display_time, normalize_effort, round6, usd, window_id
from tokentide.operators import (
    asof,
    chunked,
    detector,
    diagnostics,
    fork,
    health,
    ingest,
    intervals,
    islands,
    parse,
    pricing,
    quota,
    samples,
    sessions,
    trend,
    usage,
)
from tokentide.operators.kept import KeptUsage
from tokentide.plans.scan import LogScan
from tokentide.schemas import TOKEN_FIELDS
from tokentide.session import configure, stage, staging_folder
from tokentide.sources import adapters, histories, logs, logtree
from tokentide.sources.history_store import HistoryStore
from tokentide.sources.ratecard import built_in, own_card

NOW = datetime(2024, 1, 20, tzinfo=UTC)
RANGE_START = datetime(2024, 1, 15, tzinfo=UTC)
RANGE_END = datetime(2024, 1, 25, tzinfo=UTC)
ACCOUNT = "a1"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def edge(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, other columns as they are."""
    return df.select(
        *[
            F.unix_micros(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema
        ]
    )


def query(name: str):
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: edge(build(Tables(spark, sf_dir)))
        return build

    return register


class Tables:
    """Canonical tables derived from the `events` table of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark = spark
        self.ev = adapters.events(spark, sf_dir)

    @cached_property
    def usage(self) -> DataFrame:
        return adapters.usage(self.ev)

    @cached_property
    def with_mode(self) -> DataFrame:
        return asof.as_of(self.usage, "timestamp", adapters.mode_switches(self.ev), "fast")

    @cached_property
    def priced(self) -> DataFrame:
        return pricing.price(self.with_mode)

    @cached_property
    def samples(self) -> DataFrame:
        return adapters.samples(self.ev)

    @cached_property
    def session_events(self) -> DataFrame:
        return sessions.session_events(self.priced)

    @cached_property
    def windows(self) -> DataFrame:
        return quota.quota_windows(self.samples)

    @cached_property
    def detection(self) -> detector.Detection:
        return detector.Detection(adapters.rising_samples(self.ev), stage(adapters.busy_usage(self.priced), "busy"))

    @cached_property
    def events(self) -> DataFrame:
        return stage(parse.parse_lines(adapters.log_lines(self.ev)), "events")

    @cached_property
    def forks(self) -> DataFrame:
        lines = stage(adapters.fork_lines(self.ev), "forklines")
        return fork.replay_prefix(fork.parents(fork.lineage(parse.parse_lines(lines))), lines)

    @cached_property
    def accounts(self):
        return adapters.account_switches(self.ev), "a0"

    @cached_property
    def token_events(self) -> DataFrame:
        modes = (adapters.mode_switches(self.ev), None)
        return ingest.token_events(self.events, None, self.accounts, modes, RANGE_START, RANGE_END, ACCOUNT)


# --- usage ------------------------------------------------------------------

for _group in usage.GROUPS:
    query(f"usage_by_{_group}")(lambda t, g=_group: usage.usage_by(t.priced, g))


@query("usage_by_month_kept")
def _(t):
    """Months from kept sums up to a closed time, and from records after it."""
    kept = KeptUsage.at(t.spark, f"{staging_folder(t.spark)}/kept-{uuid.uuid4().hex}")
    kept.close(t.priced, RANGE_START)
    kept.close(t.priced, RANGE_END)
    return kept.usage_by(t.priced, "month")


query("usage_by_model_effort")(lambda t: usage.usage_by(t.priced, "model", effort=True))
query("usage_totals")(lambda t: usage.usage_totals(t.priced, "model"))
query("usage_topk_credits")(lambda t: usage.usage_by(t.priced, "cwd", sort="credits", limit=5))
query("fast_attribution")(lambda t: usage.fast_attribution(t.priced))
query("unpriced_models")(lambda t: pricing.unpriced_models(t.priced).drop("note"))


@query("price_usage")
def _(t):
    return t.priced.select(
        F.col("line_no").alias("event_id"),
        "priced",
        "pricing_label",
        "billable_input_tokens",
        "billed_cached_tokens",
        "credit_multiplier",
        round6("credits").alias("credits"),
        usd("credits").alias("usd"),
    )


@query("price_own_card")
def _(t):
    """A card of 30 credits a dollar with rates of five decimals."""
    rows = "('gpt-5.5', 'Five', 1.00125, 0.00125, 3.33333, 1.3333, NULL), ('gpt-5.4', 'Four', 0.5, 0.12345, 2.0, 1.0, NULL)"
    card = own_card(t.spark, rows, "30 credits = $1")
    return pricing.price(t.with_mode, card).select(
        F.col("line_no").alias("event_id"),
        "pricing_label",
        round6("credits").alias("credits"),
        usd("credits", card.credits_per_usd).alias("usd"),
    )


@query("asof_account")
def _(t):
    got = asof.as_of(t.usage.drop("account_id"), "timestamp", adapters.account_switches(t.ev), "account_id", "a9")
    return got.select(F.col("line_no").alias("event_id"), "account_id")


@query("asof_mode")
def _(t):
    return t.with_mode.select(F.col("line_no").alias("event_id"), "fast")


@query("scalar_keys")
def _(t):
    """Names, ids and display times of every record."""
    return t.usage.select(
        F.col("line_no").alias("event_id"),
        normalize_effort("reasoning_effort").alias("effort"),
        window_id(F.lit("5h"), "account_id", F.lit("Pro Plan!"), "reasoning_effort", "timestamp").alias("window_id"),
        display_time("timestamp").alias("shown"),
    )


# --- sessions ---------------------------------------------------------------

query("sessions_top")(lambda t: sessions.sessions_top(t.priced))
query("sessions_all")(lambda t: sessions.session_rows(t.priced))
query("sessions_totals")(lambda t: sessions.sessions_totals(t.priced))
query("session_events")(lambda t: sessions.order_events(t.session_events))
query("session_by_model")(lambda t: sessions.session_breakdown(t.session_events, "model"))
query("session_by_cwd")(lambda t: sessions.session_breakdown(t.session_events, "cwd"))
query("session_by_effort")(lambda t: sessions.session_breakdown(t.session_events, "effort"))
query("session_switches")(lambda t: sessions.session_switches(t.session_events))
query("session_compact")(lambda t: sessions.session_compact(t.session_events, 3))


@query("session_compact_busy")
def _(t):
    """The timeline over long sessions of few runs, which then compete for rows."""
    return sessions.session_compact(sessions.session_events(adapters.few_runs(t.priced)), 20)


# --- ordered scans ----------------------------------------------------------


@query("counter_diff")
def _(t):
    rows = adapters.with_counters(t.usage)
    got = chunked.carry_forward(rows, ["session_id"], "block", ["line_no"], before={"previous": F.col("total_counter")})
    grown = F.greatest(F.col("total_counter") - F.col("previous"), F.lit(0))
    delta = (
        F.when(F.col("total_counter").isNull(), F.col("total_tokens"))
        .when(F.col("previous").isNull(), F.col("total_counter"))
        .otherwise(grown)
    )
    return got.select(F.col("line_no").alias("event_id"), delta.alias("delta"))


@query("carry_forward")
def _(t):
    k = F.col("k")
    rows = t.usage.withColumn("block", chunked.time_chunk("timestamp"))
    got = chunked.carry_forward(
        rows,
        ["session_id"],
        "block",
        ["line_no"],
        inclusive={"model": F.when(k % 4 == 0, F.col("model")), "cwd": F.when(k % 5 == 0, F.col("cwd"))},
    )
    return got.select(
        F.col("line_no").alias("event_id"), F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("cwd", F.lit("unknown")).alias("cwd")
    )


# --- samples and quota windows ----------------------------------------------


@query("samples_dedup")
def _(t):
    copies = t.samples.where(F.col("source_line") % 7 == 0).withColumn("session_id", F.concat(F.lit("r"), "session_id"))
    rows = samples.dedup_samples(t.samples.unionByName(copies))
    return rows.drop("source_path", "remaining_percent").withColumnRenamed("source_line", "event_id")


query("inactive_streams")(lambda t: samples.inactive_streams(t.samples))
query("sample_counters")(lambda t: samples.sample_counters(t.samples))


@query("samples_active")
def _(t):
    return samples.active_samples(t.samples).select(
        F.col("source_line").alias("event_id"), "timestamp", "window_minutes", "used_percent", "resets_at"
    )


@query("samples_filtered")
def _(t):
    got = samples.filter_samples(t.samples, RANGE_START, RANGE_END, ACCOUNT, "pro", 300)
    return samples.order_samples(got).select(F.col("source_line").alias("event_id"), "timestamp", "remaining_percent")


query("quota_windows")(lambda t: quota.order_windows(t.windows).drop("island"))
query("quota_windows_merged")(
    # Windows of single days, merged in order.
    lambda t: quota.order_windows(islands.windows_of(islands.merge_parts(islands.window_parts(t.samples, F.to_date("timestamp"))))).drop("island")
)
query("quota_resets")(lambda t: quota.order_changes(quota.quota_resets(t.samples)))
query("quota_resets_early")(lambda t: quota.order_changes(quota.quota_resets(t.samples, early_only=True)))
query("quota_unknown_limit_resets")(lambda t: quota.unknown_limit_resets(quota.quota_resets(t.samples)))
query("quota_current")(lambda t: quota.order_current(quota.quota_current(t.samples, NOW)).drop("estimated_start"))
query("quota_current_status")(lambda t: quota.current_status(quota.quota_current(t.samples, NOW)))
query("quota_trend")(lambda t: quota.order_changes(trend.quota_trend(t.samples)))
query("quota_trend_creeping")(lambda t: quota.order_changes(trend.quota_trend(adapters.creeping_samples(t.ev), block_rows=1000)))


# --- interval joins ---------------------------------------------------------


@query("windows_usage_attach")
def _(t):
    return quota.order_windows(intervals.attach_usage(t.windows, t.priced)).select(
        "id", "first_seen", "sample_count", "total_tokens", "credits", "usd"
    )


query("windows_usage_range")(lambda t: intervals.usage_range(t.windows))


@query("windows_overlapping")
def _(t):
    return intervals.overlapping(t.windows, RANGE_START, RANGE_END).select("id", "first_seen", "estimated_start", "reset_at")


query("limit_usage_window")(lambda t: intervals.usage_by_window(t.priced, t.windows, "5h"))
query("limit_usage_model")(lambda t: intervals.usage_by_window(t.priced, t.windows, "5h", "model", sort="tokens"))
query("limit_usage_cwd")(lambda t: intervals.usage_by_window(t.priced, t.windows, "5h", "cwd"))
query("limit_usage_account")(lambda t: intervals.usage_by_window(t.priced, t.windows, "7d", "account"))
query("limit_usage_unobserved")(lambda t: intervals.unobserved_usage(t.priced, t.windows))


# --- detector ---------------------------------------------------------------


@query("detector_pairs")
def _(t):
    return detector.sample_pairs(detector.observations(adapters.rising_samples(t.ev)))


@query("detector_intervals")
def _(t):
    return t.detection.intervals.withColumn("delta_used_percent", round6("delta_used_percent"))


@query("detector_segments")
def _(t):
    return t.detection.segments.select(
        *detector.SEGMENT,
        "segment_start",
        "segment_end",
        round6("delta_used_percent").alias("delta_used_percent"),
        "sample_pairs",
        "calls",
        "total_tokens",
        round6("normal_credits").alias("normal_credits"),
        "model",
        "mixed",
        "file_path",
    )


query("detector_candidates")(lambda t: t.detection.candidates())
query("detector_reasons")(lambda t: t.detection.reasons())
query("detector_counters")(lambda t: t.detection.counters())


# --- logs -------------------------------------------------------------------


@query("parse_usage_lines")
def _(t):
    rows = ingest.carried(ingest.with_forks(t.events, None)).where(ingest.is_token_event())
    return rows.withColumn("usage", ingest.counter_diff()).select(
        ((F.col("line_no") - 1) / 2).cast("long").alias("event_id"),
        "timestamp",
        "session_id",
        "model",
        "cwd",
        "reasoning_effort",
        "has_info",
        *[F.col(f"usage.{f}").alias(f) for f in TOKEN_FIELDS],
    )


@query("parse_quota_lines")
def _(t):
    got = ingest.quota_samples(t.events, None, t.accounts)
    return got.select(
        ((F.col("source_line") - 1) / 2).cast("long").alias("event_id"),
        "timestamp", "session_id", "account_id", "plan_type", "limit_id", "window", "window_minutes",
        "used_percent", "remaining_percent", "resets_at",
    )


@query("usage_records")
def _(t):
    return t.token_events.where("skip_reason IS NULL").select(
        ((F.col("line_no") - 1) / 2).cast("long").alias("event_id"),
        "timestamp", "model", "fast", "account_id", F.size("rate_limits").alias("limits"), "input_tokens", "total_tokens",
    )


@query("skip_reasons")
def _(t):
    reason = F.coalesce("skip_reason", F.lit("included")).alias("reason")
    return t.token_events.groupBy(reason).agg(F.count("*").alias("events")).orderBy("reason")


@query("replay_skips")
def _(t):
    """Every third user's files as forks that replay their first 500 event ids; replayed context lines don't count."""
    user = F.regexp_extract("session_id", r"^s(\d+)-", 1).cast("long")
    files = t.usage.groupBy("file_path", "session_id").agg(F.min("line_no").alias("least")).where(user % 3 == 0)
    forks = files.select(
        "file_path", F.concat(F.lit("p-"), "session_id").alias("pinned_id"), ((F.col("least") + 500) * 2).alias("replay_prefix_lines")
    )
    modes = (adapters.mode_switches(t.ev), None)
    events = ingest.token_events(t.events, forks, t.accounts, modes, RANGE_START, RANGE_END, ACCOUNT)
    reason = F.coalesce("skip_reason", F.lit("included")).alias("reason")
    pinned = F.col("session_id").startswith("p-").alias("pinned")
    return events.groupBy(reason, "model", pinned).agg(F.count("*").alias("events"))


@query("usage_diagnostics")
def _(t):
    return diagnostics.side_by_side(diagnostics.usage_line_counters(t.events), diagnostics.skip_counters(t.token_events))


@query("sample_diagnostics")
def _(t):
    events = ingest.with_forks(t.events, None)
    found = ingest.sample_events(t.events, None, t.accounts, RANGE_START, RANGE_END, ACCOUNT, "pro", 300)
    return diagnostics.side_by_side(
        diagnostics.sample_line_counters(events),
        diagnostics.limit_only_files(events),
        diagnostics.sample_filter_counters(found),
    )


@query("warnings")
def _(t):
    counters = diagnostics.side_by_side(
        diagnostics.usage_line_counters(t.events),
        diagnostics.skip_counters(t.token_events),
        t.priced.agg(F.count_if(~F.col("priced")).alias("unpriced_calls")),
    )
    return diagnostics.warnings(counters).select("code", "count")


@query("file_prune")
def _(t):
    files = adapters.log_files(t.usage)
    action = logs.file_action(
        F.col("file_name"), F.col("relative"), F.col("mtime"), logs.ScanRange(RANGE_START, RANGE_END)
    )
    return files.select(
        "file_path", logs.path_session_id(F.col("file_name"), F.col("file_path")).alias("session_id"), action.alias("action")
    )


@query("stale_files")
def _(t):
    """Tail candidates whose last record lies before the range."""
    scan = logs.ScanRange(RANGE_START, RANGE_END)
    files = adapters.log_files(t.usage)
    files = files.withColumn("action", logs.file_action(F.col("file_name"), F.col("relative"), F.col("mtime"), scan))
    ids = files.withColumn("session_id", logs.path_session_id(F.col("file_name"), F.col("file_path")))
    records = t.usage.drop("file_path").join(ids.select("session_id", "file_path"), "session_id")
    return ingest.stale_files(records, files, RANGE_START, F.lit(True))


query("fork_replay")(lambda t: t.forks)
query("fork_counters")(lambda t: fork.fork_counters(t.forks))


@query("fork_names")
def _(t):
    """Parents that no scanned file opens with, found by parts of session ids in file names."""
    files = adapters.log_files(t.usage)
    user = F.regexp_extract("session_id", r"^s(\d+)-", 1).cast("long")
    ids = logs.path_session_id(F.col("file_name"), F.col("file_path"))
    part = F.when(user % 4 == 0, F.substring("session_id", 2, 99)).when(user % 4 == 1, F.substring("session_id", -5, 5)).when(
        user % 4 == 2, F.concat(F.lit("x"), "session_id")
    )
    heads = files.withColumn("session_id", ids).select(
        F.concat(F.lit("/kids/"), "session_id").alias("file_path"),
        F.concat(F.lit("kid-"), "session_id").alias("first_id"),
        F.coalesce(part, F.concat(F.lit("-"), "session_id", F.lit(".jsonl"))).alias("second_id"),
    )
    return fork.parents(heads, files)


# --- folders of logs ---------------------------------------------------------


def _scanned(scan: LogScan) -> DataFrame:
    return scan.usage_records().select(
        F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        "line_no", "timestamp", "session_id", "model", "cwd", "input_tokens", "total_tokens",
    )


@query("scan_records")
def _(t):
    """Usage records of a folder of logs and its archive."""
    return _scanned(LogScan(t.spark, logtree.write(t.ev), RANGE_START, RANGE_END))


@query("scan_counters")
def _(t):
    return LogScan(t.spark, logtree.write(t.ev), RANGE_START, RANGE_END).usage_diagnostics().select(
        "read_files", "skipped_files", "prefiltered_files", "tail_read_files", "tail_read_hits", "mtime_read_files", "scanned_directories",
        "skipped_directories", "read_lines", "invalid_json_lines", "token_count_events", "included_usage_events", "out_of_range",
    )


@query("scan_indexed")
def _(t):
    """The second of two reports that share an index of the files."""
    root = logtree.write(t.ev)
    index = f"{root}-index"
    LogScan(t.spark, root, RANGE_START, RANGE_END, manifest=index).events  # noqa: B018
    return _scanned(LogScan(t.spark, root, RANGE_START, RANGE_END, manifest=index))


# --- histories and health ---------------------------------------------------


@query("history_normalize")
def _(t):
    rows = histories.attribution(histories.normalize_accounts(adapters.account_log(t.ev)))
    return histories.ordered(rows).drop("pos")


@query("history_status")
def _(t):
    return histories.mode_status(adapters.mode_switches(t.ev), NOW)


@query("history_commits")
def _(t):
    """The same through the durable store: one commit of all switches, one switch more, and a repeated request."""
    store = HistoryStore(t.spark, f"{staging_folder(t.spark)}/history-{uuid.uuid4().hex}")
    modes = adapters.mode_switches(t.ev).groupBy("ts").agg(F.max_by("fast", "pos").alias("fast"), F.lit(histories.MANUAL_SOURCE).alias("source"))
    store.append(modes, "all", 0)
    for _ in range(2):
        store.switch_mode(True, NOW, "on")
    records = asof.as_of(t.usage, "timestamp", store.read()[1], "fast")
    return records.groupBy("fast").agg(F.count("*").alias("records"))


@query("history_append")
def _(t):
    """Records after a switch appended at the report time see the new mode."""
    old = adapters.mode_switches(t.ev).withColumn("source", F.lit("manual file edit"))
    history = histories.append_mode(old, True, NOW)
    return asof.as_of(t.usage, "timestamp", history, "fast").groupBy("fast").agg(F.count("*").alias("records"))


query("health_usage")(lambda t: health.health_usage(t.priced, NOW))
query("health_unpriced")(lambda t: health.health_unpriced(t.priced, NOW).drop("note"))
query("health_quota")(lambda t: health.health_quota(t.samples, NOW))


@query("rate_card_use")
def _(t):
    """Priced models of the card with the calls that used them."""
    card = pricing.inventory(built_in(t.spark)).where(F.col("status") == "priced")
    calls = t.priced.where(F.col("priced")).groupBy(F.col("pricing_label").alias("label")).agg(F.count("*").alias("calls"))
    return card.join(calls, "label", "left").select("card_key", "label", "in_rate", "fast_mult", F.coalesce("calls", F.lit(0)).alias("calls"))
