"""Session log lines to typed events, and rate limits to quota samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions import variants as V
from tokentide.functions.scalars import window_label
from tokentide.schemas import TOKEN_FIELDS

PLACE = ("file_path", "block", "line_no")
USAGE_MARKS = ('"token_count"', '"session_meta"', '"turn_context"')
LIMIT_MARKS = ('"rate_limits"', '"session_meta"', '"turn_context"')


PAYLOAD = (
    "type", "id", "model", "cwd", "reasoning_effort", "model_reasoning_effort", "model_config", "reasoning",
    "collaboration_mode", "info", "rate_limits",
)
EFFORT = ("effort", "reasoning_effort")


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t.title() for t in tail)


def marked(*marks: str) -> Column:
    """Substring test that runs before any JSON is parsed."""
    test = F.col("value").contains(marks[0])
    for mark in marks[1:]:
        test = test | F.col("value").contains(mark)
    return test


def _spellings(name: str) -> list[str]:
    return list(dict.fromkeys([name, _camel(name)]))


def _either(struct: str, name: str) -> Column:
    """A field in either spelling."""
    return F.coalesce(*[F.col(f"{struct}.{n}") for n in _spellings(name)])


def _counters(name: str) -> Column:
    return V.each(V.counter, *[_either(name, f) for f in TOKEN_FIELDS])


def _usage(name: str) -> Column:
    """Five counters; null when input, output and total are all missing."""
    got = {f: F.get(name, F.lit(i)) for i, f in enumerate(TOKEN_FIELDS)}
    some = F.coalesce(got["input_tokens"], got["output_tokens"], got["total_tokens"]).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.coalesce(got["total_tokens"], zero(got["input_tokens"]) + zero(got["output_tokens"]))
    values = [zero(got[f]).alias(f) for f in TOKEN_FIELDS if f != "total_tokens"] + [total.alias("total_tokens")]
    return F.when(some, F.struct(*values))


def _limit_windows(entries: Column) -> Column:
    """Named windows of a rate-limit object in order, each with the reason it is refused, if any.

    Three passes, so that a value is read once however often it is tested.
    """
    opened = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("name"), V.fields(e["value"], "window_minutes", "used_percent", "resets_at").alias("f")
        ),
    )
    typed = F.transform(
        opened,
        lambda x: F.struct(
            x["name"].alias("name"),
            V.integer(x["f"]["window_minutes"]).alias("minutes"),
            V.finite_number(x["f"]["used_percent"]).alias("used"),
            V.seconds_time(x["f"]["resets_at"]).alias("resets"),
        ),
    )

    def judged(x: Column) -> Column:
        name, minutes, used, resets = x["name"], x["minutes"], x["used"], x["resets"]
        reject = (
            F.when(minutes.isNull() | (minutes <= 0), "window_minutes")
            .when(used.isNull(), "used_percent")
            .when(resets.isNull(), "resets_at")
        )
        return F.struct(
            F.when(name == "primary", 0).when(name == "secondary", 1).otherwise(2).alias("rank"),
            name.alias("name"),
            minutes.alias("window_minutes"),
            used.alias("used_percent"),
            resets.alias("resets_at"),
            window_label(name, minutes).alias("window"),
            (~name.isin("primary", "secondary")).alias("unknown"),
            reject.alias("reject"),
            (reject.isNull() & ~used.between(0.0, 100.0)).alias("out_of_range"),
        )

    # Most lines name one window, which needs no sort.
    return V.bound(F.transform(typed, judged), lambda all_: F.when(F.size(all_) > 1, F.array_sort(all_)).otherwise(all_))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed events of all lines that carry a marker; parsing happens once for every report.

    valid:     the line is JSON
    limits:    state of `payload.rate_limits` - missing, null, other, object - or null when
               the line is no limit event
    windows:   its windows in order (primary, secondary, then by name)
    """
    names = [n for f in PAYLOAD for n in _spellings(f)]
    effort = [n for f in EFFORT for n in _spellings(f)]
    usage = [n for f in TOKEN_FIELDS for n in _spellings(f)]
    has = lambda mark: F.col("value").contains(mark)
    # One step per nesting level, so that every object is opened once.
    rows = lines.where(marked(*USAGE_MARKS, LIMIT_MARKS[0])).withColumn("v", V.line(F.col("value")))
    rows = rows.withColumn("e", V.fields(F.col("v"), "type", "timestamp", "payload", path="$[0]"))
    rows = rows.withColumn("p", V.fields(F.col("e.payload"), *names))
    rows = rows.withColumns(
        {
            "config": V.fields(_either("p", "model_config"), *effort),
            "reasoning": V.fields(F.col("p.reasoning"), *effort),
            "mode": V.fields(V.at(_either("p", "collaboration_mode"), "$.settings"), *effort),
            "info": V.fields(F.col("p.info"), *[n for f in ("total_token_usage", "last_token_usage") for n in _spellings(f)]),
            "limit_map": F.try_variant_get(F.col("p.rate_limits"), "$", "map<string,variant>"),
        }
    )
    rows = rows.withColumns(
        {
            "total": V.fields(_either("info", "total_token_usage"), *usage),
            "last": V.fields(_either("info", "last_token_usage"), *usage),
            "entries": F.filter(
                F.map_entries("limit_map"),
                lambda e: ~e["key"].isin("plan_type", "limit_id")
                & (e["key"].isin("primary", "secondary") | V.is_object(e["value"])),
            ),
            "text": V.each(
                V.string,
                F.col("e.type"),
                *[F.col(f"p.{f}") for f in ("type", "id", "model", "cwd")],
                _either("p", "reasoning_effort"),
                _either("p", "model_reasoning_effort"),
                *[c for place in ("config", "reasoning", "mode") for c in (F.col(f"{place}.effort"), _either(place, "reasoning_effort"))],
            ),
            "trimmed": V.each(V.trimmed_string, F.col("e.type"), F.try_element_at("limit_map", F.lit("plan_type")), F.try_element_at("limit_map", F.lit("limit_id"))),
        }
    )
    is_limit_event = has(LIMIT_MARKS[0]) & F.coalesce(F.get("trimmed", F.lit(0)) == "event_msg", F.lit(False))
    state = (
        F.when(F.col("p.rate_limits").isNull(), "missing")
        .when(F.is_variant_null("p.rate_limits"), "null")
        .when(F.col("limit_map").isNotNull(), "object")
        .otherwise("other")
    )
    rows = rows.withColumns(
        {
            "total": _counters("total"),
            "last": _counters("last"),
            "limits": F.when(is_limit_event, state),
            "windows": F.when(is_limit_event, _limit_windows(F.col("entries"))),
            "sample_time": F.when(is_limit_event, V.sample_time(F.col("e.timestamp"))),
            "timestamp": V.event_time(F.col("e.timestamp")),
        }
    )
    keep = [c for c in lines.columns if c != "value"]
    text = lambda i: F.get("text", F.lit(i))
    return rows.select(
        *keep,
        has(USAGE_MARKS[0]).alias("has_token"),
        has(USAGE_MARKS[1]).alias("has_meta"),
        has(USAGE_MARKS[2]).alias("has_turn"),
        has(LIMIT_MARKS[0]).alias("has_limits"),
        F.col("v").isNotNull().alias("valid"),
        text(0).alias("event_type"),
        "timestamp",
        text(1).alias("payload_type"),
        text(2).alias("meta_id"),
        text(3).alias("meta_model"),
        text(4).alias("meta_cwd"),
        F.coalesce(*[text(i) for i in range(5, 13)]).alias("meta_effort"),
        F.col("info").isNotNull().alias("has_info"),
        _usage("total").alias("total_usage"),
        _usage("last").alias("last_usage"),
        "limits",
        "sample_time",
        F.get("trimmed", F.lit(1)).alias("plan_type"),
        F.get("trimmed", F.lit(2)).alias("limit_id"),
        "windows",
    )


def rate_limits_of(windows: Column, plan: Column, limit: Column) -> Column:
    """Accepted windows of a line as the array a usage record carries."""
    good = F.filter(windows, lambda w: w["reject"].isNull())
    made = F.transform(
        good,
        lambda w: F.struct(
            plan.alias("plan_type"),
            limit.alias("limit_id"),
            w["window"].alias("window"),
            w["window_minutes"].alias("window_minutes"),
            w["resets_at"].alias("resets_at"),
        ),
    )
    return F.coalesce(made, F.array().cast("array<struct<plan_type:string,limit_id:string,window:string,window_minutes:bigint,resets_at:timestamp>>"))


def explode_limits(events: DataFrame) -> DataFrame:
    """One row per accepted quota window of the limit events."""
    live = events.where((F.col("limits") == "object") & F.col("sample_time").isNotNull())
    rest = [c for c in events.columns if c not in ("windows", "timestamp")]
    rows = live.select(*rest, F.explode("windows").alias("w")).where(F.col("w.reject").isNull())
    return rows.select(
        *[c for c in rest if c not in ("sample_time", "limits")],
        F.col("sample_time").alias("timestamp"),
        F.col("w.window").alias("window"),
        F.col("w.window_minutes").alias("window_minutes"),
        F.col("w.used_percent").alias("used_percent"),
        (F.lit(100.0) - F.col("w.used_percent")).alias("remaining_percent"),
        F.col("w.resets_at").alias("resets_at"),
        F.col("w.out_of_range").alias("out_of_range"),
    )
