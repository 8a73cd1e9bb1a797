"""Column expressions shared by the reports: keys, names, ids, rounding, display."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two reset times count as equal when they differ by at most 60 whole seconds.
JITTER_MICROS = 61_000_000
PERCENT_EPSILON = 0.000001
FIVE_HOURS = 300
SEVEN_DAYS = 10080
CREDIT = "decimal(38,12)"

# Spelling variants of model names and the rate-card key they mean.
MODEL_ALIASES = {
    "gpt-5.4 mini": "gpt-5.4-mini",
    "gpt-5.3 codex": "gpt-5.3-codex",
    "gpt-image-2:image": "gpt-image-2 (image)",
    "gpt-image-2-image": "gpt-image-2 (image)",
    "gpt-image-2 image": "gpt-image-2 (image)",
    "gpt-image-2.0:image": "gpt-image-2 (image)",
    "gpt-image-2.0-image": "gpt-image-2 (image)",
    "gpt-image-2.0 image": "gpt-image-2 (image)",
    "gpt-image-2.0 (image)": "gpt-image-2 (image)",
    "gpt-image-2:text": "gpt-image-2 (text)",
    "gpt-image-2-text": "gpt-image-2 (text)",
    "gpt-image-2 text": "gpt-image-2 (text)",
    "gpt-image-2.0:text": "gpt-image-2 (text)",
    "gpt-image-2.0-text": "gpt-image-2 (text)",
    "gpt-image-2.0 text": "gpt-image-2 (text)",
    "gpt-image-2.0 (text)": "gpt-image-2 (text)",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def non_blank(col: Column | str) -> Column:
    """The string itself, or null when it has no visible character."""
    return F.when(_c(col).rlike(r"\S"), _c(col))


def trimmed(col: Column | str) -> Column:
    """The string without surrounding white space, or null when nothing is left."""
    return F.nullif(F.regexp_replace(_c(col), r"^\s+|\s+$", ""), F.lit(""))


def within_jitter(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.unix_micros(_c(a)) - F.unix_micros(_c(b))) < JITTER_MICROS


# --- calendar keys ----------------------------------------------------------


def _wall(ts: Column | str, tz: str | None) -> Column:
    """Wall-clock time: in the session zone, or in `tz` when given."""
    local = _c(ts).cast("timestamp_ntz")
    return local if tz is None else F.convert_timezone(F.current_timezone(), F.lit(tz), local)


def time_key(ts: Column | str, unit: str, tz: str | None = None) -> Column:
    wall = _wall(ts, tz)
    if unit == "week":
        return F.concat(
            F.date_part(F.lit("YEAROFWEEK"), wall).cast("string"),
            F.lit("-W"),
            F.lpad(F.weekofyear(wall).cast("string"), 2, "0"),
        )
    patterns = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    return F.date_format(wall, patterns[unit])


def display_time(ts: Column | str, tz: str | None = None) -> Column:
    return F.date_format(_wall(ts, tz), "yyyy-MM-dd HH:mm:ss")


def iso_millis(ts: Column | str) -> Column:
    return F.date_format(_wall(ts, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def range_label(start: Column | str, end: Column | str, tz: str | None = None) -> Column:
    """`a`, or `a -> b` when the two differ at display precision."""
    a, b = display_time(start, tz), display_time(end, tz)
    return F.when(a == b, a).otherwise(F.concat_ws(" -> ", a, b))


def off_time(segment_end: Column | str) -> Column:
    """First millisecond after a segment."""
    return _c(segment_end) + F.expr("INTERVAL 1 MILLISECOND")


# --- names and ids ----------------------------------------------------------


def normalize_effort(effort: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(_c(effort)), "[^a-z0-9]+", "-")
    return F.nullif(F.btrim(dashed, F.lit("-")), F.lit(""))


def model_key(model: Column | str, fast: Column | str, effort: Column | str | None = None) -> Column:
    """Model name with its mode suffix and, if asked, its effort suffix; `unknown` stays bare."""
    model = _c(model)
    key = F.concat(model, F.when(_c(fast), F.lit("-fast")).otherwise(F.lit("")))
    if effort is not None:
        suffix = F.concat(F.lit("-"), normalize_effort(effort))
        key = F.concat(key, F.coalesce(suffix, F.lit("")))
    return F.when(model == "unknown", model).otherwise(key)


def normalize_model(model: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(model), r"\s+", " ")))


def pricing_key(model: Column | str) -> Column:
    name = normalize_model(model)
    aliases = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def window_label(name: Column | str, minutes: Column | str) -> Column:
    return (
        F.when(_c(minutes) == FIVE_HOURS, F.lit("5h")).when(_c(minutes) == SEVEN_DAYS, F.lit("7d")).otherwise(_c(name))
    )


def id_part(col: Column | str, when_null: str | None = None) -> Column:
    value = _c(col) if when_null is None else F.coalesce(_c(col), F.lit(when_null))
    dashed = F.lower(F.regexp_replace(value, "[^A-Za-z0-9]", "-"))
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("unknown"))


def window_id(window: Column | str, account: Column | str, plan: Column | str, limit: Column | str, reset: Column | str) -> Column:
    return F.concat_ws(
        "-",
        id_part(window),
        id_part(account, "unknown_account"),
        id_part(plan, "unknown_plan"),
        id_part(limit, "unknown_limit"),
        F.lit("reset"),
        F.unix_seconds(_c(reset)).cast("string"),
    )


# --- numbers ----------------------------------------------------------------


def round6(col: Column | str) -> Column:
    """Six decimals, half away from zero, as double (exact on decimals)."""
    return F.round(_c(col), 6).cast("double")


def round_metric(col: Column | str) -> Column:
    """Six-decimal rounding of a non-negative double."""
    return F.floor((_c(col) + F.lit(2.220446049250313e-16)) * 1e6 + 0.5) / F.lit(1e6)


def usd(credits: Column | str, credits_per_usd: Decimal = Decimal(25)) -> Column:
    """Credits (decimal) in dollars: divided at 15 decimals or more, then rounded like credits."""
    return F.round(_c(credits).cast("decimal(28,12)") / F.lit(credits_per_usd), 6).cast("double")


def grouped_int(col: Column | str) -> Column:
    return F.format_number(_c(col), 0)


def grouped_2dp(col: Column | str) -> Column:
    return F.format_number(_c(col).cast("decimal(38,2)"), 2)


def dollars(col: Column | str) -> Column:
    return F.concat(F.lit("$"), grouped_2dp(col))


def percent_text(col: Column | str) -> Column:
    """Up to two decimals, without trailing zeros, with a percent sign."""
    text = F.format_string("%.2f", _c(col).cast("double"))
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("%"))
