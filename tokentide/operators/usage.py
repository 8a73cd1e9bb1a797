"""Usage reports: grouping, totals, mode attribution, ordering."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.scalars import model_key, round6, time_key, usd
from tokentide.schemas import TOKEN_FIELDS

GROUPS = ("hour", "day", "week", "month", "model", "cwd", "account")
SORTS = ("time", "tokens", "credits", "calls", "sessions")
MEASURES = ("calls", *TOKEN_FIELDS, "credits", "priced_calls", "unpriced_calls")


def positive(n: int | None, name: str = "limit") -> int | None:
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n <= 0):
        raise ValueError(f"{name} must be a positive integer: {n!r}")
    return n


def one_of(value: str | None, allowed: tuple[str, ...], name: str) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}: {value!r}")
    return value


def group_key(group: str, effort: bool = False, tz: str | None = None) -> Column:
    one_of(group, GROUPS, "group")
    if group == "model":
        return model_key("model", "fast", "reasoning_effort" if effort else None)
    if group == "cwd":
        return F.col("cwd")
    if group == "account":
        return F.coalesce("account_id", F.lit("unknown"))
    return time_key("timestamp", group, tz)


def measures() -> list[Column]:
    """Sums of one level of raw records."""
    return [
        F.count("*").alias("calls"),
        *[F.sum(f).alias(f) for f in TOKEN_FIELDS],
        F.sum("credits").alias("credits"),
        F.count_if(F.col("priced")).alias("priced_calls"),
        F.count_if(~F.col("priced")).alias("unpriced_calls"),
    ]


def roll_up() -> list[Column]:
    """Sums of already aggregated measures."""
    return [F.sum(m).alias(m) for m in MEASURES]


def by_session(priced: DataFrame, key: Column) -> DataFrame:
    """First aggregation level (key, session): exact session counts then need no distinct,
    and one hot key is already spread over its sessions."""
    return priced.groupBy(key.alias("key"), "session_id").agg(*measures())


def _rows(per_session: DataFrame, rate: Decimal) -> DataFrame:
    sums = per_session.groupBy("key").agg(F.count("session_id").alias("sessions"), *roll_up())
    return sums.withColumn("usd", usd("credits", rate)).withColumn("credits", round6("credits"))


def order_rows(rows: DataFrame, group: str, sort: str | None) -> DataFrame:
    one_of(sort, SORTS, "sort")
    sort = sort or ("tokens" if group == "model" else "time")
    column = {"tokens": "total_tokens"}.get(sort, sort)
    return rows.orderBy("key") if sort == "time" else rows.orderBy(F.desc(column), "key")


def usage_by(
    priced: DataFrame,
    group: str,
    effort: bool = False,
    tz: str | None = None,
    sort: str | None = None,
    limit: int | None = None,
    credits_per_usd: Decimal = Decimal(25),
) -> DataFrame:
    """One row per group key: sessions, calls, tokens, credits, usd, priced and unpriced calls."""
    rows = order_rows(_rows(by_session(priced, group_key(group, effort, tz)), credits_per_usd), group, sort)
    return rows if positive(limit) is None else rows.limit(limit)


def usage_totals(
    priced: DataFrame,
    group: str,
    effort: bool = False,
    tz: str | None = None,
    credits_per_usd: Decimal = Decimal(25),
) -> DataFrame:
    """The `Total` row: distinct sessions overall, sums over all rows, and credits
    added up from the rounded row credits."""
    per_session = by_session(priced, group_key(group, effort, tz))
    per_key = _rows(per_session, credits_per_usd).agg(
        *[F.sum(m).alias(m) for m in MEASURES if m != "credits"],
        F.sum(F.col("credits").cast("decimal(38,6)")).alias("credits"),
    )
    sessions = per_session.groupBy("session_id").agg(F.lit(1).alias("one")).agg(F.count("*").alias("sessions"))
    # Two one-row frames side by side.
    return (
        per_key.withColumn("key", F.lit("Total"))
        .join(sessions.withColumn("key", F.lit("Total")), "key")
        .withColumn("usd", usd("credits", credits_per_usd))
        .withColumn("credits", round6("credits"))
        .select("key", "sessions", *MEASURES, "usd")
    )


def fast_attribution(priced: DataFrame) -> DataFrame:
    """Calls and credits recorded while fast mode was on."""
    fast = F.coalesce(F.col("fast"), F.lit(False))
    return priced.agg(
        F.count_if(fast).alias("fast_attributed_calls"),
        round6(F.coalesce(F.sum(F.when(fast, F.col("credits"))), F.lit(Decimal(0)))).alias("fast_attributed_credits"),
    )
