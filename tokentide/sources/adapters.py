"""Canonical tables derived from a plain `events` table.

Any table of (event_id, ts, user_id, event_type, value, props '{"k": n}') can be
read as agent activity: each event becomes one usage record and one quota sample,
and some events become account or mode switches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions.scalars import window_label
from tokentide.operators.chunked import row_numbers, running_sum

DAY_MICROS = 86_400_000_000
FIVE_HOUR_MICROS = 18_000_000_000
# Where the creeping resets begin: behind all events.
CREEP_FROM = 1_900_000_000_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        ts.alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"),
        F.unix_micros(ts).alias("us"),
    )


def _session() -> Column:
    day = F.floor(F.col("us") / F.lit(float(DAY_MICROS))).cast("long")
    return F.concat(F.lit("s"), F.col("user_id"), F.lit("-"), day)


def _account() -> Column:
    return F.when(F.col("user_id") % 6 != 0, F.concat(F.lit("a"), F.col("user_id") % 5))


def _plan() -> Column:
    return F.when(F.col("user_id") % 2 == 0, "pro").otherwise("plus")


def usage(ev: DataFrame) -> DataFrame:
    """Usage records; `fast` is left to the mode history."""
    cents = F.floor(F.col("value") * 100).cast("long")
    next_reset = (F.floor(F.col("us") / F.lit(float(FIVE_HOUR_MICROS))).cast("long") + 1) * FIVE_HOUR_MICROS
    limit = F.struct(
        _plan().alias("plan_type"),
        F.col("event_type").alias("limit_id"),
        F.lit("5h").alias("window"),
        F.lit(300).cast("long").alias("window_minutes"),
        F.timestamp_micros(next_reset).alias("resets_at"),
    )
    none = F.array().cast(
        "array<struct<plan_type:string,limit_id:string,window:string,window_minutes:bigint,resets_at:timestamp>>"
    )
    model = (
        F.when(F.col("event_type") == "click", "gpt-5.5")
        .when(F.col("event_type") == "view", "GPT-5.4")
        .when(F.col("event_type") == "purchase", "gpt-5.4  mini")
        .when(F.col("event_type") == "signup", "gpt-5.2")
        .otherwise("mystery-model")
    )
    effort = F.when(F.col("k") % 3 == 1, "Low").when(F.col("k") % 3 == 2, "x High")
    return ev.select(
        F.col("ts").alias("timestamp"),
        _session().alias("session_id"),
        model.alias("model"),
        effort.alias("reasoning_effort"),
        F.concat(F.lit("/w/"), F.col("user_id") % 20).alias("cwd"),
        _account().alias("account_id"),
        F.concat(F.lit("/logs/"), _session(), F.lit(".jsonl")).alias("file_path"),
        F.col("event_id").alias("line_no"),
        F.when(F.col("k") % 4 == 0, none).otherwise(F.array(limit)).alias("rate_limits"),
        cents.alias("input_tokens"),
        (F.col("k") * 50).alias("cached_input_tokens"),
        (F.col("k") * 10).alias("output_tokens"),
        F.col("k").alias("reasoning_output_tokens"),
        (cents + F.col("k") * 10).alias("total_tokens"),
        "k",
    )


def samples(ev: DataFrame, window_minutes: int | None = None) -> DataFrame:
    """Quota samples; `window_minutes` fixes the window length instead of alternating."""
    minutes = F.when(F.col("event_id") % 2 == 0, 300).otherwise(10080) if window_minutes is None else F.lit(window_minutes)
    wide = ev.withColumn("window_minutes", minutes.cast("long")).withColumn(
        "rolling", (F.col("event_type") == "view") & (F.col("k") % 10 != 0) & (F.col("user_id") % 5 == 1)
    )
    span = F.col("window_minutes") * 60_000_000
    rolling_reset = (F.floor(F.col("us") / F.lit(1e6)).cast("long") + F.col("window_minutes") * 60) * 1_000_000
    fixed_reset = (F.floor(F.col("us") / span.cast("double")).cast("long") + 1) * span + F.col("event_id") % 3 * 20_000_000
    used = F.when(F.col("rolling"), 0.0).otherwise(F.floor(F.least("value", F.lit(100.0))).cast("double"))
    return wide.select(
        F.col("ts").alias("timestamp"),
        _session().alias("session_id"),
        _account().alias("account_id"),
        _plan().alias("plan_type"),
        F.when(F.col("k") % 10 != 0, F.col("event_type")).alias("limit_id"),
        window_label(F.lit("other"), "window_minutes").alias("window"),
        "window_minutes",
        used.alias("used_percent"),
        (F.lit(100.0) - used).alias("remaining_percent"),
        F.timestamp_micros(F.when(F.col("rolling"), rolling_reset).otherwise(fixed_reset)).alias("resets_at"),
        F.lit(None).cast("string").alias("source_path"),
        F.col("event_id").alias("source_line"),
    )


def account_switches(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("event_type") == "signup") & (F.col("k") < 20)).select(
        "ts", F.concat(F.lit("a"), F.col("user_id") % 5).alias("account_id"), F.col("event_id").alias("pos")
    )


def mode_switches(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("event_type") == "error") & (F.col("k") < 10)).select(
        "ts", (F.col("k") % 2 == 0).alias("fast"), F.col("event_id").alias("pos")
    )


def with_counters(records: DataFrame) -> DataFrame:
    """Adds the cumulative `total_counter` of the session, with gaps and reset values."""
    chunked = records.withColumn("block", F.floor(F.col("line_no") / 100_000).cast("long"))
    summed = running_sum(chunked, ["session_id"], "block", ["line_no"], F.col("total_tokens"), "running_total")
    reset = F.when(F.col("k") == 50, 5000).otherwise(0)
    return summed.withColumn(
        "total_counter", F.when(F.col("k") % 11 != 0, F.col("running_total") - reset)
    ).drop("running_total")



LINE_BLOCK = 100_000


def _text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def log_lines(ev: DataFrame) -> DataFrame:
    """JSONL lines equal to the events: a context line before some, a token count with limits for each.

    Some lines are broken, lack a timestamp, or spell fields and numbers in another way.
    """
    rows = with_counters(usage(ev)).join(
        samples(ev).select(
            F.col("source_line").alias("line_no"), "plan_type", "limit_id", "window_minutes", "used_percent", "resets_at"
        ),
        "line_no",
    )
    k = F.col("k")
    context = rows.where(k % 4 == 0).select(
        "file_path",
        (F.col("line_no") * 2).alias("line_no"),
        F.to_json(
            F.struct(
                F.lit("turn_context").alias("type"),
                F.struct(
                    "model",
                    "cwd",
                    F.struct(F.col("reasoning_effort").alias("reasoningEffort")).alias("modelConfig"),
                ).alias("payload"),
            )
        ).alias("value"),
    )
    totals = F.when(
        F.col("total_counter").isNotNull(),
        F.struct((F.col("total_counter") * 2).alias("input_tokens"), F.col("total_counter").alias("totalTokens")),
    )
    last = F.struct(
        "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"
    )
    window = F.struct(
        F.col("window_minutes"),
        F.when(k % 19 == 0, F.lit("n/a")).otherwise(F.col("used_percent").cast("string")).alias("used_percent"),
        F.unix_seconds("resets_at").alias("resets_at"),
    )
    line = F.to_json(
        F.struct(
            F.lit("event_msg").alias("type"),
            F.when(k % 17 != 0, _text("timestamp")).alias("timestamp"),
            F.struct(
                F.lit("token_count").alias("type"),
                F.when(
                    k % 23 != 0,
                    F.struct(totals.alias("total_token_usage"), F.when(k % 5 != 0, last).alias("lastTokenUsage")),
                ).alias("info"),
                F.struct("plan_type", "limit_id", window.alias("primary")).alias("rate_limits"),
            ).alias("payload"),
        )
    )
    counts = rows.select(
        "file_path",
        (F.col("line_no") * 2 + 1).alias("line_no"),
        F.when(k % 29 == 0, F.concat(line, F.lit("}"))).otherwise(line).alias("value"),
    )
    both = context.unionByName(counts)
    return both.withColumn("block", F.floor(F.col("line_no") / LINE_BLOCK).cast("long"))


def fork_lines(ev: DataFrame) -> DataFrame:
    """One file per user, and for every third user a fork that replays the start of it."""
    numbered = row_numbers(
        ev.withColumn("block", F.floor(F.col("event_id") / LINE_BLOCK).cast("long")), ["user_id"], "block", ["event_id"]
    )
    path = lambda letter: F.concat(F.lit(f"/forks/{letter}"), F.col("user_id"), F.lit(".jsonl"))

    def meta(letter: str) -> Column:
        ident = F.concat(F.lit(letter), F.col("user_id"))
        return F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(ident.alias("id")).alias("payload")))

    def event(n: Column, delay: int) -> Column:
        at = F.date_format(F.col("ts") + F.expr(f"INTERVAL {delay} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.to_json(
            F.struct(F.lit("event_msg").alias("type"), at.alias("timestamp"), F.struct(n.alias("n")).alias("payload"))
        )

    users = numbered.where(F.col("rn") == 1)
    forked = F.col("user_id") % 3 == 0
    kept = F.col("rn") <= F.col("user_id") % 7
    parts = [
        users.select(path("u").alias("file_path"), F.lit(1).cast("long").alias("line_no"), meta("u").alias("value")),
        numbered.select(path("u"), F.col("rn") + 1, event(F.col("event_id"), 0)),
        users.where(forked).select(path("c"), F.lit(1).cast("long"), meta("c")),
        users.where(forked).select(path("c"), F.lit(2).cast("long"), meta("u")),
        numbered.where(forked).select(
            path("c"), F.col("rn") + 2, F.when(kept, event(F.col("event_id"), 60)).otherwise(event(-F.col("event_id") - 1, 60))
        ),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.union(part)
    return lines.withColumn("block", F.floor(F.col("line_no") / LINE_BLOCK).cast("long"))


def log_files(records: DataFrame) -> DataFrame:
    """One log file per session, as a listing would show it."""
    per_session = records.groupBy("session_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("mtime"))
    name = F.concat(
        F.lit("rollout-"), F.date_format("first", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), F.col("session_id"), F.lit(".jsonl")
    )
    relative = F.concat(F.date_format("first", "yyyy/MM/dd/"), name)
    return per_session.select(
        F.concat(F.lit("/sessions/"), relative).alias("file_path"), name.alias("file_name"), relative.alias("relative"), "mtime"
    )


def account_log(ev: DataFrame) -> DataFrame:
    """Account switches as a history file spells them, removals included."""
    return ev.where((F.col("event_type") == "signup") & (F.col("k") < 20)).select(
        _text("ts").alias("timestamp"),
        F.concat(F.lit("a"), (F.col("user_id") + 1) % 5).alias("from_account_id"),
        F.concat(F.lit(" a"), F.col("user_id") % 5).alias("to_account_id"),
        F.when(F.col("k") % 3 == 0, "auth remove").otherwise("auth select").alias("source"),
    )


# Inputs shaped so that the detector has several calls per session and steadily rising samples.


def busy_session(df: DataFrame) -> DataFrame:
    """Coarser sessions: one per account group and day."""
    return df.withColumn("session_id", F.concat(F.coalesce("account_id", F.lit("none")), F.lit("-"), F.substring("session_id", -5, 5)))


def few_runs(records: DataFrame) -> DataFrame:
    """Coarser sessions that change their model every six hours."""
    part = F.floor(F.unix_micros("timestamp") / F.lit(21_600_000_000.0)).cast("long") % 4
    return busy_session(records).withColumns(
        {"model": F.concat(F.lit("m"), part), "reasoning_effort": F.lit(None).cast("string")}
    )


def rising_samples(ev: DataFrame) -> DataFrame:
    """Five-hour samples of one limit whose percentage rises through each window."""
    rows = samples(ev, 300).withColumn("limit_id", F.lit("main"))
    us = F.unix_micros("timestamp")
    step = F.floor((us % FIVE_HOUR_MICROS) / F.lit(180_000_000.0)).cast("double")
    reset = F.timestamp_micros((F.floor(us / F.lit(float(FIVE_HOUR_MICROS))).cast("long") + 1) * FIVE_HOUR_MICROS)
    return busy_session(
        rows.withColumn("used_percent", step).withColumn("remaining_percent", F.lit(100.0) - step).withColumn("resets_at", reset)
    )


def creeping_samples(ev: DataFrame) -> DataFrame:
    """Five-hour samples of one limit whose reset moves on by seconds with every event."""
    used = F.floor(F.col("k") / 34).cast("double")
    reset = F.timestamp_micros(CREEP_FROM + (F.col("event_id") * 2 + F.col("event_id") % 3 * 20) * 1_000_000)
    ids = ev.select(F.col("event_id").alias("source_line"), "k", "event_id")
    return (
        samples(ev, 300)
        .join(ids, "source_line")
        .withColumns({"limit_id": F.lit("main"), "used_percent": used, "remaining_percent": F.lit(100.0) - used, "resets_at": reset})
        .drop("k", "event_id")
    )


def busy_usage(records: DataFrame) -> DataFrame:
    limits = F.transform("rate_limits", lambda x: x.withField("limit_id", F.lit("main")))
    return busy_session(records.withColumn("rate_limits", limits))
