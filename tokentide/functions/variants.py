"""Tolerant typed reads from VARIANT values: a wrong type is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokentide.functions.scalars import non_blank

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"


# A value no log line holds; it closes the array a line is parsed in.
SENTINEL = "~end of line~"


def line(value: Column) -> Column:
    """A whole line as one-element VARIANT array, or null when it is not exactly one JSON value.

    The parser ignores what follows a complete value, so the line is parsed as the
    first of two array elements and the second must come back untouched.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), value, F.lit(f',"{SENTINEL}"]')))
    closed = F.try_variant_get(parsed, "$[1]", "string") == SENTINEL
    return F.when(closed & at(parsed, "$[2]").isNull(), parsed)


def fields(value: Column, *names: str, path: str = "$") -> Column:
    """Named fields of a JSON object as a struct of VARIANTs; null when it is no object."""
    return F.try_variant_get(value, path, f"struct<{', '.join(f'`{n}`: variant' for n in names)}>")


def each(read, *values: Column) -> Column:
    """`read` applied to several values, as an array; the expression is built and planned once. Null stays null, unread."""
    return F.transform(F.array(*values), lambda v: F.when(v.isNotNull(), read(v)))


def bound(value: Column, read) -> Column:
    """`read` applied to a value that is computed once, however often `read` mentions it."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def at(value: Column, path: str) -> Column:
    """The value at a path, as VARIANT; null when absent."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def is_number(value: Column) -> Column:
    return bound(kind(value), lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def string(value: Column) -> Column:
    """A JSON string with a visible character, spaces kept."""
    return bound(F.when(is_string(value), F.try_variant_get(value, "$", "string")), non_blank)


def trimmed_string(value: Column) -> Column:
    return F.regexp_replace(string(value), r"^\s+|\s+$", "")


def _double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def counter(value: Column) -> Column:
    """A JSON number as whole count; fractions are cut off, anything else is null."""
    whole = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    real = _double(value)
    cut = F.when(real >= 0, F.floor(real)).otherwise(F.ceil(real)).cast("long")
    return F.coalesce(whole, F.when(is_number(value) & (F.abs(real) < 9.2e18), cut))


def finite_number(value: Column) -> Column:
    """A finite number, also when written as text."""
    from_text = bound(trimmed_string(value), lambda text: F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double")))
    number = F.coalesce(F.when(is_number(value), _double(value)), from_text)
    return bound(number, lambda x: F.when(F.abs(x) < float("inf"), x))


def integer(value: Column) -> Column:
    """A whole number (1.0 counts), also when written as text."""
    from_text = bound(trimmed_string(value), lambda text: F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint")))
    whole = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    real = F.when(is_number(value), _double(value))
    exact = bound(real, lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 9.2e18), x.cast("long")))
    return F.coalesce(whole, exact, from_text)


# Years 1 to 9999, the range of TIMESTAMP.
MIN_SECONDS, MAX_SECONDS = -62_135_596_800, 253_402_300_799


def seconds_time(value: Column) -> Column:
    """Epoch seconds as timestamp."""
    return bound(integer(value), lambda seconds: F.when(seconds.between(MIN_SECONDS, MAX_SECONDS), F.timestamp_seconds(seconds)))


def _millis_time(millis: Column) -> Column:
    return bound(millis, lambda x: F.when(x.between(MIN_SECONDS * 1000, MAX_SECONDS * 1000), F.timestamp_millis(x)))


def _text_time(text: Column) -> Column:
    """RFC 3339 only: the regular expression is stricter than the timestamp parser."""
    return bound(text, lambda x: F.when(x.rlike(RFC3339), F.upper(x).try_cast("timestamp")))


def event_time(value: Column) -> Column:
    """RFC 3339 text, or epoch milliseconds (fractions cut off)."""
    text = F.when(is_string(value), F.try_variant_get(value, "$", "string"))
    return F.coalesce(_text_time(text), _millis_time(counter(value)))


def sample_time(value: Column) -> Column:
    """Like `event_time`, but the text may have spaces around and fractional milliseconds are refused."""
    whole = F.when(is_number(value), integer(value))
    return F.coalesce(_text_time(trimmed_string(value)), _millis_time(whole))
