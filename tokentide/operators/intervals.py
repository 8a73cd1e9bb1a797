"""Joins of usage records to time intervals (quota windows, sample pairs).

Every interval is exploded into time buckets and met by an equi-join on bucket and
account, so no theta join ever runs. Where only the number of overlapping intervals counts,
a sweep turns them into disjoint spans first. The exploded side is counted: it is broadcast only
when proven small, and otherwise shuffled, where AQE may split a hot bucket on the record side.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tokentide.functions.scalars import JITTER_MICROS, round6, usd, within_jitter
from tokentide.operators.chunked import swept
from tokentide.operators.usage import SORTS, group_key, measures, one_of, positive, roll_up
from tokentide.schemas import TOKEN_FIELDS
from tokentide.session import MAX_BROADCAST_ROWS, broadcast_if_small, stage

RECORD = ("file_path", "line_no")
SELECTORS = {"5h": 300, "7d": 10080}


def _size(kls: Column | int) -> Column:
    """Bucket length in microseconds of a size class: eight times that of the class below, from one second on."""
    if isinstance(kls, int):
        return F.lit(1_000_000 * 8**kls).cast("long")
    return (F.pow(F.lit(8.0), kls) * 1_000_000).cast("long")


def number_targets(targets: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """The targets as a staged table with `target_no`, increasing by (start, end, id).

    A number keeps the per-record aggregates on plain longs, and its order serves the
    latest-window rule.
    """
    numbered = targets.orderBy(start, end, *(["id"] if "id" in targets.columns else []))
    return stage(numbered.withColumn("target_no", F.monotonically_increasing_id()), name)


def _timed(targets: DataFrame, closed: str) -> DataFrame:
    """Targets as (target_no, t_*): half-open times in microseconds, without empty ones."""
    shift = 0 if closed == "left" else 1
    return targets.select(
        "target_no",
        (F.unix_micros("start") + shift).alias("t_start"),
        (F.unix_micros("end") + shift).alias("t_end"),
        F.col("account_id").alias("t_account"),
        F.col("window_minutes").alias("t_minutes"),
        F.col("plan_type").alias("t_plan"),
        F.col("limit_id").alias("t_limit"),
        F.col("reset_at").alias("t_reset"),
    ).where("t_end > t_start")


def _spread(rows: DataFrame) -> tuple[DataFrame, list[Row]]:
    """Rows with [t_start, t_end) once per time bucket they touch (`meet`), and the kinds of buckets that occur.

    Buckets are sized by each span's own length: at least a quarter and less than twice of it, so a span touches at most five
    of them and meets little besides what it holds, however dense the spans are. A row without an account is open to all
    records, another one to its account's.
    """
    span = (F.col("t_end") - F.col("t_start")).cast("double")
    kls = F.greatest(F.ceil(F.log(8.0, span / 4_000_000.0)), F.lit(0)).cast("int")
    sized = rows.withColumn("kls", kls).withColumns(
        {"first": F.floor(F.col("t_start") / _size(F.col("kls"))), "last": F.floor((F.col("t_end") - 1) / _size(F.col("kls")))}
    )
    # A class per factor of eight, about ten from seconds to decades, times two account kinds.
    present = (
        sized.groupBy("kls", F.col("t_account").isNull().alias("open"))
        .agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
        .orderBy("kls", "open")
        .collect()
    )
    spread = sized.withColumn("bucket", F.explode(F.sequence("first", "last")))
    return spread.withColumn("meet", _meeting(F.col("kls"), F.col("bucket"), F.col("t_account"))).drop(
        "kls", "first", "last", "bucket"
    ), present


def _meeting(kls: Column, bucket: Column, account: Column) -> Column:
    return F.named_struct(F.lit("kls"), kls.cast("int"), F.lit("bucket"), bucket.cast("long"), F.lit("account"), account)


def _meetings(present: list[Row], us: Column, account: Column) -> Column:
    """The buckets in which a record can meet a target: one per kind, once if it has no account."""
    nobody = F.lit(None).cast("string")
    wanted = [_meeting(F.lit(r["kls"]), F.floor(us / _size(r["kls"])), nobody if r["open"] else account) for r in present]
    none = F.array().cast("array<struct<kls:int,bucket:bigint,account:string>>")
    return F.array_distinct(F.array(*wanted)) if wanted else none


_INSIDE = "us >= t_start and us < t_end"


def _checked(side: DataFrame, present: list[Row]) -> DataFrame:
    return F.broadcast(side) if sum(r["n"] for r in present) <= MAX_BROADCAST_ROWS else side


def _limited() -> Column:
    return F.size("rate_limits") > 0


def exact_matches(records: DataFrame, targets: DataFrame, carry: list[str], closed: str = "left") -> DataFrame:
    """(record, target) pairs where one of the record's own rate limits names the target.

    An equi-join on (length, plan, limit, reset bucket, account, time bucket): with a reset bucket as wide as the
    jitter, a reset meets its own and the two neighbouring buckets.
    """
    fits = lambda limit, minutes, plan, name, reset: (
        (limit["window_minutes"] == minutes)
        & within_jitter(limit["resets_at"], reset)
        & limit["plan_type"].eqNullSafe(plan)
        & limit["limit_id"].eqNullSafe(name)
    )
    bucket = lambda reset: F.floor(F.unix_micros(reset) / JITTER_MICROS)
    named = lambda minutes, plan, name, n: F.named_struct(
        F.lit("minutes"), minutes, F.lit("plan"), plan, F.lit("name"), name, F.lit("n"), n
    )
    spread, present = _spread(_timed(targets, closed))
    side = spread.withColumn("name", named(F.col("t_minutes"), F.col("t_plan"), F.col("t_limit"), bucket(F.col("t_reset"))))
    keep = list(dict.fromkeys([*RECORD, *carry]))
    us = F.unix_micros("timestamp")
    limits = records.where(_limited()).select(
        *keep,
        us.alias("us"),
        _meetings(present, us, F.col("account_id")).alias("meetings"),
        "rate_limits",
        F.posexplode("rate_limits").alias("pos", "limit"),
    )
    around = [
        named(F.col("limit.window_minutes"), F.col("limit.plan_type"), F.col("limit.limit_id"), bucket(F.col("limit.resets_at")) + d)
        for d in (-1, 0, 1)
    ]
    probe = limits.withColumn("r_name", F.explode(F.array(*around))).withColumn("r_meet", F.explode("meetings"))
    target = [F.col(c) for c in ("t_minutes", "t_plan", "t_limit", "t_reset")]
    on = (F.col("r_name") == F.col("name")) & (F.col("r_meet") == F.col("meet")) & F.expr(_INSIDE)
    found = probe.join(_checked(side, present), on)
    # Of several limits that name one target the first counts.
    again = F.exists(F.slice("rate_limits", 1, F.col("pos")), lambda limit: fits(limit, *target))
    return found.where(fits(F.col("limit"), *target) & ~again).select(*keep, "target_no")


def coverage(targets: DataFrame, by: list[str], closed: str = "left") -> DataFrame:
    """Disjoint spans of time per account and `by` (of t_minutes, t_plan) with the number of targets that cover them.

    A sweep over the targets' ends: running sums of +1 and -1, and of the targets' numbers, so a
    span that one target covers names it.
    """
    rows = _timed(targets, closed).withColumn("key", F.struct("t_account", *by))
    ends = rows.select("key", F.col("t_start").alias("at"), F.lit(1).alias("d"), F.col("target_no").alias("no")).unionByName(
        rows.select("key", F.col("t_end").alias("at"), F.lit(-1).alias("d"), (-F.col("target_no")).alias("no"))
    )
    turns = (
        ends.withColumn("chunk", F.floor(F.col("at") / 3_600_000_000))
        .groupBy("key", "chunk", "at")
        .agg(F.sum("d").cast("long").alias("d"), F.sum("no").alias("no"))
    )
    # Read twice, for the chunks' sums and for the rows.
    spans = swept(stage(turns, "turns"), ["key"], "chunk", "at", ["d", "no"])
    return spans.where("before IS NOT NULL AND upto_d > d").select(
        "key.*",
        F.col("before").alias("t_start"),
        F.col("at").alias("t_end"),
        (F.col("upto_d") - F.col("d")).alias("n"),
        (F.col("upto_no") - F.col("no")).alias("target_no"),
    )


def covering(records: DataFrame, targets: DataFrame, carry: list[str], by: list[str], closed: str = "left") -> DataFrame:
    """For each record and group of targets that agree with it in time and account: their number `n`, and the target if it is alone.

    records: file_path, line_no, timestamp, account_id and `carry`
    targets: target_no, start, end, account_id, plan_type, limit_id, window_minutes, reset_at
    A target without an account takes every record; one with an account only its own. Groups are split by
    t_account and `by`. Each record meets one span per group, however many targets overlap.
    """
    spread, present = _spread(stage(coverage(targets, by, closed), "coverage"))
    keep = list(dict.fromkeys([*RECORD, *carry]))
    us = F.unix_micros("timestamp")
    probe = records.select(*keep, us.alias("us"), F.explode(_meetings(present, us, F.col("account_id"))).alias("r_meet"))
    found = probe.join(_checked(spread, present), (F.col("r_meet") == F.col("meet")) & F.expr(_INSIDE))
    return found.select(*keep, "t_account", *by, "n", "target_no")


def _window_targets(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "target_no",
        F.col("estimated_start").alias("start"),
        F.col("reset_at").alias("end"),
        "account_id",
        "plan_type",
        "limit_id",
        "window_minutes",
        "reset_at",
    )


def _number_windows(windows: DataFrame) -> DataFrame:
    return number_targets(windows, "estimated_start", "reset_at", "windows")


# --- usage attached to every matching window --------------------------------


def attach_matches(numbered: DataFrame, priced: DataFrame) -> DataFrame:
    """(record, target_no) pairs: all exact matches of a record if it has any, else the windows
    that are its only candidate within (length, account, plan)."""
    carry = ["total_tokens", "credits"]
    targets = _window_targets(numbered)
    exact = exact_matches(priced, targets, carry)
    # Records with limits that match nothing fall back to the rule for records without.
    slim = priced.select(*RECORD, "timestamp", "account_id", "rate_limits", *carry)
    unmatched = slim.where(_limited()).join(exact.select(*RECORD), list(RECORD), "left_anti")
    rest = slim.where(~_limited()).unionByName(unmatched)
    lone = covering(rest, targets, carry, ["t_minutes", "t_plan"])
    columns = [*RECORD, "target_no", *carry]
    return exact.select(columns).unionByName(lone.where(F.col("n") == 1).select(columns))


def attach_usage(windows: DataFrame, priced: DataFrame, credits_per_usd: Decimal = Decimal(25)) -> DataFrame:
    """`windows` with total_tokens, credits and usd of the usage they cover."""
    numbered = _number_windows(windows)
    sums = attach_matches(numbered, priced).groupBy("target_no").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("credits").alias("credits")
    )
    zero = F.lit(Decimal(0)).cast("decimal(38,12)")
    return (
        numbered.join(sums, "target_no", "left")
        .withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)))
        .withColumn("usd", usd(F.coalesce("credits", zero), credits_per_usd))
        .withColumn("credits", round6(F.coalesce("credits", zero)))
        .drop("target_no")
    )


def usage_range(windows: DataFrame) -> DataFrame:
    """Time span the windows' usage can fall in; narrows the usage scan."""
    return windows.agg(F.min("estimated_start").alias("start"), F.max("reset_at").alias("end"))


def overlapping(windows: DataFrame, start, end) -> DataFrame:
    """Windows that touch the report range."""
    return windows.where((F.col("reset_at") > F.lit(start)) & (F.col("estimated_start") <= F.lit(end)))


# --- usage assigned to at most one window -----------------------------------


def assign_windows(priced: DataFrame, numbered: DataFrame) -> DataFrame:
    """Adds `window_id`: the one window a record belongs to, or null.

    With rate limits only an exact match counts, the latest by (start, reset, id);
    without, the record must have a single candidate.
    """
    targets = _window_targets(numbered)
    best = exact_matches(priced, targets, []).groupBy(*RECORD).agg(F.max("target_no").alias("target_no"))
    groups = covering(priced.where(~_limited()), targets, [], [])
    lone = groups.groupBy(*RECORD).agg(F.sum("n").alias("n"), F.sum("target_no").alias("target_no")).where(F.col("n") == 1)
    hits = best.unionByName(lone.select(*RECORD, "target_no"))
    ids = broadcast_if_small(numbered.select("target_no", F.col("id").alias("window_id")))
    return priced.join(hits.join(ids, "target_no").drop("target_no"), list(RECORD), "left")


def usage_by_window(
    priced: DataFrame,
    windows: DataFrame,
    selector: str = "7d",
    group: str = "window",
    effort: bool = False,
    sort: str | None = None,
    limit: int | None = None,
    tz: str | None = None,
    credits_per_usd: Decimal = Decimal(25),
) -> DataFrame:
    """Usage per quota window of one length, optionally split by model, cwd or account.

    Usage outside every window forms `unobserved` rows. Grouped by window, windows
    without usage show as zero rows, and an empty report has one zero row.
    """
    one_of(selector, tuple(SELECTORS), "selector")
    one_of(group, ("window", "model", "cwd", "account"), "group")
    one_of(sort, SORTS, "sort")
    windows = _number_windows(windows.where(F.col("window_minutes") == SELECTORS[selector]))
    assigned = assign_windows(priced, windows)
    missing = f"unobserved:{selector}"
    key = F.coalesce("window_id", F.lit("unobserved")) if group == "window" else group_key(group, effort, tz)
    per_session = assigned.groupBy(
        F.coalesce("window_id", F.lit(missing)).alias("window_id"), key.alias("group_key"), "session_id"
    ).agg(*measures())
    sums = per_session.groupBy("window_id", "group_key").agg(F.count("*").alias("sessions"), *roll_up())

    attrs = ("account_id", "plan_type", "limit_id", "window", "window_minutes", "estimated_start", "reset_at")
    # Windows that share an id merge; their first one lends the attributes.
    known = (
        windows.groupBy(F.col("id").alias("window_id"))
        .agg(F.min_by(F.struct(*attrs), F.struct("reset_at", "estimated_start")).alias("a"))
        .select("window_id", "a.*")
    )
    if group == "window":
        # The sums are tested and read twice.
        sums = stage(sums, "windowsums")
        zero = known.select("window_id", F.col("window_id").alias("group_key"))
        spark = priced.sparkSession
        nothing = spark.sql(f"SELECT '{missing}' AS window_id, 'unobserved' AS group_key")
        if windows.isEmpty() and sums.isEmpty():
            zero = nothing
        sums = zero.unionByName(sums.select("window_id", "group_key")).distinct().join(sums, ["window_id", "group_key"], "left")
    rows = sums.join(broadcast_if_small(known), "window_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    credits = F.coalesce("credits", F.lit(Decimal(0)).cast("decimal(38,12)"))
    rows = rows.select(
        "window_id",
        "account_id",
        "plan_type",
        "limit_id",
        F.coalesce("window", F.lit(selector)).alias("window"),
        F.coalesce("window_minutes", F.lit(SELECTORS[selector])).alias("window_minutes"),
        F.col("estimated_start").alias("window_start"),
        "reset_at",
        F.col("reset_at").isNotNull().alias("observed"),
        F.lit(group).alias("group_by"),
        "group_key",
        count("sessions"),
        count("calls"),
        *[count(f) for f in TOKEN_FIELDS],
        round6(credits).alias("credits"),
        usd(credits, credits_per_usd).alias("usd"),
        count("priced_calls"),
        count("unpriced_calls"),
    )
    rows = order_window_usage(rows, sort)
    return rows if positive(limit) is None else rows.limit(limit)


def order_window_usage(rows: DataFrame, sort: str | None = None) -> DataFrame:
    lead = {"tokens": "total_tokens", "credits": "credits", "calls": "calls", "sessions": "sessions"}.get(sort or "time")
    by_window = [F.asc_nulls_last("reset_at"), F.asc_nulls_last("window_start"), "group_key", "window_id"]
    return rows.orderBy(*([F.desc(lead)] if lead else []), *by_window)


def unobserved_usage(priced: DataFrame, windows: DataFrame) -> DataFrame:
    """Observed windows, and usage events outside all of them."""
    windows = _number_windows(windows)
    events = assign_windows(priced, windows).agg(F.count_if(F.col("window_id").isNull()).alias("unobserved_usage_events"))
    seen = windows.agg(F.count("*").alias("observed_windows"))
    one = F.lit(1)
    return seen.withColumn("one", one).join(events.withColumn("one", one), "one").drop("one")

