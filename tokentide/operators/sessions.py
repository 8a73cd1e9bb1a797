"""Session reports: top sessions, drill-down, breakdowns, switches, compact timeline."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.scalars import model_key, range_label, round6, usd
from tokentide.operators.chunked import linked, time_chunk
from tokentide.operators.usage import MEASURES, SORTS, measures, one_of, positive
from tokentide.schemas import TOKEN_FIELDS
from tokentide.session import stage

DEFAULT_TOP = 10
COMPACT_ROWS = 20
EVENT_ORDER = ("timestamp", "model", "file_path", "line_no")

def top_n(top: int | None = None, limit: int | None = None) -> int:
    """`top` wins over `limit`, which wins over ten."""
    return positive(top, "top") or positive(limit) or DEFAULT_TOP

def session_rows(priced: DataFrame, credits_per_usd: Decimal = Decimal(25), exact_credits: bool = False) -> DataFrame:
    """One row per session; model and cwd are the last known ones in (file, line) order."""
    place = F.struct("file_path", "line_no")

    def last_known(name: str) -> Column:
        known = F.max_by(name, F.when(F.col(name) != "unknown", place))
        return F.coalesce(known, F.lit("unknown")).alias(name)

    rows = priced.groupBy("session_id").agg(
        last_known("model"),
        last_known("cwd"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        *measures(),
        F.min_by("file_path", place).alias("file_path"),
    )
    rows = rows.withColumn("usd", usd("credits", credits_per_usd))
    return rows if exact_credits else rows.withColumn("credits", round6("credits"))

def order_sessions(rows: DataFrame, sort: str | None = None) -> DataFrame:
    one_of(sort, SORTS, "sort")
    orders = {
        "time": [F.desc("last_seen")],
        "tokens": [F.desc("total_tokens")],
        "credits": [F.desc("credits"), F.desc("total_tokens")],
        "calls": [F.desc("calls")],
        "sessions": [],
    }
    return rows.orderBy(*orders[sort or "credits"], "session_id")

def sessions_top(priced: DataFrame, sort: str | None = None, n: int = DEFAULT_TOP, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    return order_sessions(session_rows(priced, credits_per_usd), sort).limit(top_n(n))

def sessions_totals(priced: DataFrame, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    """Totals over all sessions; credits are added unrounded and rounded once."""
    totals = session_rows(priced, credits_per_usd, exact_credits=True).agg(
        F.count("*").alias("sessions"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]
    )
    return totals.select(
        F.lit("Total").alias("key"),
        "sessions",
        *[m for m in MEASURES if m != "credits"],
        round6("credits").alias("credits"),
        usd("credits", credits_per_usd).alias("usd"),
    )

# --- one session, or every session at once ----------------------------------

def session_events(priced: DataFrame, session_id: str | None = None, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    """Event rows with per-event rounded credits; all sessions unless one is named."""
    rows = priced if session_id is None else priced.where(F.col("session_id") == session_id)
    return rows.select(
        "session_id",
        "timestamp",
        "model",
        "fast",
        "reasoning_effort",
        "cwd",
        *TOKEN_FIELDS,
        round6("credits").alias("credits"),
        usd("credits", credits_per_usd).alias("usd"),
        "priced",
        "file_path",
        "line_no",
    )

def order_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = events.orderBy("session_id", *EVENT_ORDER)
    return rows if positive(limit) is None else rows.limit(limit)

def session_breakdown(events: DataFrame, by: str, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    """Sums of the event rows per (session, model | cwd | effort); credits add up rounded."""
    keys = {
        "model": model_key("model", "fast"),
        "cwd": F.col("cwd"),
        "effort": F.coalesce("reasoning_effort", F.lit("unknown")),
    }
    one_of(by, tuple(keys), "by")
    exact = events.withColumn("credits", F.col("credits").cast("decimal(38,6)"))
    rows = exact.groupBy("session_id", keys[by].alias("key")).agg(*measures())
    return (
        rows.withColumn("sessions", F.lit(1).cast("long"))
        .withColumn("usd", usd("credits", credits_per_usd))
        .withColumn("credits", round6("credits"))
        .orderBy("session_id", F.desc("credits"), F.desc("total_tokens"), "key")
    )

def _chunked(events: DataFrame) -> DataFrame:
    return events.withColumn("chunk", time_chunk("timestamp"))

def session_switches(events: DataFrame) -> DataFrame:
    """How often model, cwd and effort change along each session's event order."""
    rows = linked(
        _chunked(events).withColumn("effort", F.coalesce("reasoning_effort", F.lit("unknown"))),
        ["session_id"],
        "chunk",
        EVENT_ORDER,
        ["model", "cwd", "effort"],
    )
    return rows.groupBy("session_id").agg(
        *[
            F.count_if(F.col(f"prev.{c}") != F.col(c)).alias(f"{n}_switches")
            for n, c in (("model", "model"), ("cwd", "cwd"), ("reasoning_effort", "effort"))
        ]
    )


def with_runs(events: DataFrame) -> DataFrame:
    """Adds `rn`, the row number, and `run`, the number of the run of equal (model, effort), per session."""

    def changed(prev: Column, cur: Column) -> Column:
        same_effort = prev["reasoning_effort"].eqNullSafe(cur["reasoning_effort"])
        return (prev["model"] != cur["model"]) | ~same_effort

    fields = ["model", "reasoning_effort"]
    return linked(_chunked(events), ["session_id"], "chunk", EVENT_ORDER, fields, changed).drop("prev")


def session_compact(events: DataFrame, max_rows: int = COMPACT_ROWS, tz: str | None = None, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    """At most about `max_rows` timeline rows per session.

    Up to `max_rows` events stay single; as many runs or more give a row per run;
    otherwise the spare rows go, one at a time, to the run furthest below its
    share. That greedy choice equals taking the (run, b-th extra bucket) pairs
    with the largest `len / total * max_rows - b`, so it is a top-k per session.
    """
    positive(max_rows, "max_rows")
    exact = F.col("credits").cast("decimal(38,6)").alias("credits")
    needed = events.select("session_id", *EVENT_ORDER, "reasoning_effort", *TOKEN_FIELDS, exact, "priced")
    # Behind the row numbers the place of a row is not needed.
    rows = stage(with_runs(needed).drop("file_path", "line_no", "chunk"), "runs")
    runs = rows.groupBy("session_id", "run").agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"))
    per_session = runs.groupBy("session_id").agg(F.sum("n").alias("events_total"), F.count("*").alias("run_total"))
    shares = runs.join(per_session, "session_id")
    # Only sessions with fewer runs than rows compete for spare rows; a run never takes more than max_rows.
    contest = shares.where((F.col("events_total") > max_rows) & (F.col("run_total") < max_rows) & (F.col("n") > 1))
    extra = contest.withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - 1, F.lit(max_rows)))))
    deficit = F.col("n") / F.col("events_total") * F.lit(float(max_rows)) - F.col("b")
    # At most max_rows * max_rows pairs per session.
    first = Window.partitionBy("session_id").orderBy(F.desc(deficit), "run", "b")
    won = (
        extra.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= F.lit(max_rows) - F.col("run_total"))
        .groupBy("session_id", "run")
        .agg(F.count("*").alias("won"))
    )
    buckets = shares.join(won, ["session_id", "run"], "left").select(
        "session_id",
        "run",
        "n",
        "first_rn",
        F.when(F.col("events_total") <= max_rows, F.col("n"))
        .when(F.col("run_total") >= max_rows, F.lit(1))
        .otherwise(1 + F.coalesce("won", F.lit(0)))
        .alias("k"),
    )
    bucket = F.expr("((rn - first_rn + 1) * k + n - 1) div n - 1")
    # Model and effort are the same throughout a run.
    out = (
        rows.join(buckets, ["session_id", "run"])
        .withColumn("bucket", bucket)
        .groupBy("session_id", "run", "bucket", "model", "reasoning_effort")
        .agg(
            F.min("timestamp").alias("start"),
            F.max("timestamp").alias("end"),
            F.count("*").alias("events"),
            *[F.sum(f).alias(f) for f in TOKEN_FIELDS],
            F.sum("credits").alias("credits"),
            F.count_if(~F.col("priced")).alias("unpriced_calls"),
        )
        .orderBy("session_id", "run", "bucket")
    )
    # What follows from other columns is added to the ordered rows.
    return out.select(
        "session_id",
        "run",
        "bucket",
        "start",
        "end",
        "events",
        "model",
        "reasoning_effort",
        *TOKEN_FIELDS,
        round6("credits").alias("credits"),
        "unpriced_calls",
        usd("credits", credits_per_usd).alias("usd"),
        range_label("start", "end", tz).alias("label"),
    )
