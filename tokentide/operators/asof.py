"""As-of lookup of a slowly changing value (account, mode) at each row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.operators.chunked import row_numbers, time_chunk
from tokentide.session import MAX_BROADCAST_ROWS, stage

DAY_SECONDS = 86_400
# Switches of a longer history that share a broadcast row, at most.
PACK = 16


def intervals(switches: DataFrame, value: str) -> DataFrame:
    """[start, end) validity of each switch; of several at one instant the last by `pos` counts.

    The successor is found within day chunks first, then across chunk heads, so
    no task ever sorts the whole history.
    """
    last = (
        switches.groupBy("ts")
        .agg(F.max_by(F.struct(F.col(value)), "pos").alias("v"))
        .select(F.col("ts").alias("start"), F.col(f"v.{value}").alias("value"))
        .withColumn("chunk", time_chunk("start", DAY_SECONDS))
    )
    heads = last.groupBy("chunk").agg(F.min("start").alias("head"))
    following = heads.select("chunk", F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("chunk")).alias("after"))
    inside = F.lead("start").over(Window.partitionBy("chunk").orderBy("start"))
    return (
        last.withColumn("next", inside)
        .join(following, "chunk")
        .select("start", F.coalesce("next", "after").alias("end"), "value")
    )


def _met(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds `_value` of the span that holds a row's `_us`, else null; the spans, proven few, are broadcast."""
    # The number of hexadecimal digits of the length.
    spans = spans.withColumn("_digits", F.length(F.hex(F.col("_end") - F.col("_start"))))
    sizes = sorted(r[0] for r in spans.select("_digits").distinct().collect())
    size = F.expr("shiftleft(1L, 4 * _digits)")
    history = spans.withColumn("_at", F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size))))
    history = history.select(F.struct("_digits", "_at").alias("_bucket"), "_start", "_end", "_value", F.lit(True).alias("_found"))
    bucket = lambda d: F.named_struct(F.lit("_digits"), F.lit(d), F.lit("_at"), F.floor(F.col("_us") / (1 << 4 * d)))
    nowhere = F.array(F.lit(None).cast("struct<_digits: int, _at: bigint>"))
    probe = rows.withColumn("_probe", F.explode(F.when(F.col("_inside"), F.array(*map(bucket, sizes))).otherwise(nowhere) if sizes else nowhere))
    on = (F.col("_probe") == F.col("_bucket")) & (F.col("_us") >= F.col("_start")) & (F.col("_us") < F.col("_end"))
    return probe.join(F.broadcast(history), on, "left").where("_found OR NOT _inside").select(*rows.columns, "_value")


def _lookup(rows: DataFrame, spans: DataFrame, n: int, most: int) -> DataFrame:
    """Adds `_value` of the one of `n` gapless spans that holds a row's `_us`, else null; at most `most` spans are broadcast.

    Neighbouring spans of a longer history are packed into blocks, up to `PACK` in one. Up to `PACK` times `most` spans the blocks
    are broadcast and no row is shuffled; of more, a row learns its block's number in the same way and meets the block by it.
    """
    if n <= most:
        return _met(rows, spans)
    size = min(PACK, -(-n // most))
    spans = spans.withColumns({"_all": F.lit(0), "_day": F.floor(F.col("_start") / (DAY_SECONDS * 1_000_000))})
    numbered = row_numbers(spans, ["_all"], "_day", ["_start"], "_rn").withColumn("_block", F.expr(f"(_rn - 1) div {size}"))
    steps = F.array_sort(F.collect_list(F.struct("_start", "_value"))).alias("_steps")
    blocks = stage(numbered.groupBy("_block").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), steps), "history")
    count = -(-n // size)
    if count <= most:
        found = _met(rows, blocks.withColumnRenamed("_steps", "_value")).withColumnRenamed("_value", "_steps")
    else:
        found = _lookup(rows, blocks.select("_start", "_end", F.col("_block").alias("_value")), count, most)
        # Rows outside are dealt by their task, so they are not one key.
        key = F.coalesce("_value", -1 - F.spark_partition_id().cast("long"))
        found = found.withColumn("_block", key).drop("_value").join(blocks.select("_block", "_steps"), "_block", "left").drop("_block")
    before = F.filter("_steps", lambda x: x["_start"] <= F.col("_us"))
    return found.withColumn("_value", F.try_element_at(before, F.lit(-1))["_value"]).drop("_steps")


def as_of(df: DataFrame, ts: str, switches: DataFrame, value: str, default=None, out: str | None = None) -> DataFrame:
    """Adds `out`: the value of the latest switch at or before `ts`, else `default`, else null.

    Rows before the first or after the last switch need no join. The others meet the validity intervals in time
    buckets whose size follows the interval's length (powers of 16 microseconds): an interval touches at most two
    buckets, and a bucket of one size holds at most 17 intervals of it, however close the switches lie. The
    history is broadcast while its rows are proven few; a longer one in blocks of neighbouring switches (`_lookup`).
    """
    out = out or value
    ends = switches.agg(
        F.count("*").alias("n"),
        F.min(F.unix_micros("ts")).alias("first"),
        F.max(F.unix_micros("ts")).alias("last"),
        F.max_by(F.struct(F.col(value)), F.struct("ts", "pos")).alias("tail"),
    ).first()
    kind = switches.schema[value].dataType
    fallback = F.lit(default).cast(kind)
    if ends.n == 0:
        return df.withColumn(out, fallback)

    start, end = F.unix_micros("start"), F.unix_micros("end")
    spans = intervals(switches, value).where("end IS NOT NULL").select(
        start.alias("_start"), end.alias("_end"), F.col("value").alias("_value")
    )
    us = F.unix_micros(ts)
    inside = F.coalesce((us >= ends.first) & (us < ends.last), F.lit(False))
    found = _lookup(df.withColumns({"_us": us, "_inside": inside}), spans, ends.n, MAX_BROADCAST_ROWS // 2)
    picked = (
        F.when(F.col("_us") >= ends.last, F.lit(ends.tail[0]).cast(kind))
        .when(F.col("_us") >= ends.first, F.col("_value"))
        .when(F.col("_us").isNotNull(), fallback)
    )
    # The intervals are disjoint and leave no gap: one bucket of a row inside finds its interval.
    return found.select(*[c for c in df.columns if c != out], picked.alias(out))
