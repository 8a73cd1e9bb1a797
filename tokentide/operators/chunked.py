"""Ordered scans that never put one key into one task.

A plain `Window.partitionBy(key)` sorts a whole key in one task, so a file or a
quota stream holding a third of all rows would stall the job. Here every key is
cut into chunks (file splits, or hours of a stream). The window runs inside the
chunk; per-chunk summaries - one row per chunk, built with map-side partial
aggregation - run through a second, tiny window over the key; and the carry-in
is joined back on (key, chunk), the partitioning the rows already have.

Keys must be non-null columns (use a struct for nullable parts) and the chunk
must grow with the order columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 3600


def time_chunk(ts: str, seconds: int = CHUNK_SECONDS) -> Column:
    """Chunk number of a timestamp column."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    inclusive: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
) -> DataFrame:
    """Last non-null value of each expression, up to the row or strictly before it."""
    inclusive, before = inclusive or {}, before or {}
    exprs = {**inclusive, **before}
    base = df.withColumns({f"_v_{n}": e for n, e in exprs.items()})
    rank = _order_key(order)
    tails = base.groupBy(*keys, chunk).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_t_{n}") for n in exprs]
    )
    over_key = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, chunk, *[F.last(f"_t_{n}", ignorenulls=True).over(over_key).alias(f"_c_{n}") for n in exprs]
    )
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    prior = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns(
        {
            **{f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in inclusive},
            **{f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(prior) for n in before},
        }
    )
    return local.join(carried, [*keys, chunk]).select(
        *[F.col(c) for c in df.columns if c not in exprs],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in exprs],
    )


def linked(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    fields: Sequence[str],
    starts: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds `prev`, `rn` and, given `starts`, `run`, in a single pass over chunk summaries.

    prev: struct of `fields` of the preceding row of the key (null at its start)
    rn:   1-based row number within the key
    run:  1-based number of the run, a run beginning where `starts(prev, current)` holds
          (and at the first row of the key)
    """
    over_key = Window.partitionBy(*keys).orderBy(chunk)
    earlier = over_key.rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)

    def begins(prev: Column, current: Column) -> Column:
        opened = F.lit(False) if starts is None else F.coalesce(starts(prev, current), F.lit(False))
        return F.when(prev.isNull(), True).otherwise(opened)

    base = df.withColumn("_cur", F.struct(*fields)).withColumn("_lag", F.lag("_cur").over(in_chunk))
    inner = F.when(F.col("_lag").isNotNull() & begins(F.col("_lag"), F.col("_cur")), 1).otherwise(0)
    rank = _order_key(order)
    chunks = base.groupBy(*keys, chunk).agg(
        F.min_by("_cur", rank).alias("_head"),
        F.max_by("_cur", rank).alias("_tail"),
        F.sum(inner.cast("long")).alias("_inner"),
        F.count("*").alias("_n"),
    )
    joined_chunks = chunks.withColumn("_before", F.lag("_tail").over(over_key)).withColumn(
        "_opens", F.col("_inner") + begins(F.col("_before"), F.col("_head")).cast("long")
    )
    carried = joined_chunks.select(
        *keys,
        chunk,
        "_before",
        F.coalesce(F.sum("_opens").over(earlier), F.lit(0)).alias("_runs"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
    )
    rows = base.join(carried, [*keys, chunk]).withColumn("prev", F.coalesce("_lag", "_before"))
    rows = rows.withColumn("rn", F.col("_rows") + F.row_number().over(in_chunk))
    if starts is not None:
        opens = begins(F.col("prev"), F.col("_cur")).cast("long")
        rows = rows.withColumn("_opens", opens).withColumn("run", F.col("_runs") + F.sum("_opens").over(upto))
    return rows.drop("_cur", "_lag", "_before", "_runs", "_rows", "_opens")


def running_sum(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Running sum of a non-null integer expression, the current row included."""
    base = df.withColumn("_f", value.cast("long"))
    totals = base.groupBy(*keys, chunk).agg(F.sum("_f").alias("_n"))
    over_key = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, chunk, F.coalesce(F.sum("_n").over(over_key), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.withColumn("_run", F.sum("_f").over(upto))
        .join(offsets, [*keys, chunk])
        .withColumn(out, F.col("_run") + F.col("_off"))
        .drop("_f", "_run", "_off")
    )


def swept(df: DataFrame, keys: Sequence[str], chunk: str, at: str, sums: Sequence[str]) -> DataFrame:
    """Adds `before`, the preceding row's `at` within the key (null at its start), and `upto_*`, the running sums of the non-null
    integer columns `sums`, the current row included, in a single pass. Rows of a key differ in `at`."""
    tails = df.groupBy(*keys, chunk).agg(F.max(at).alias("_tail"), *[F.sum(c).alias(f"_n_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, chunk, F.max("_tail").over(earlier).alias("_before"), *[F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums]
    )
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(at)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumns({"_lag": F.lag(at).over(in_chunk), **{f"_run_{c}": F.sum(c).over(upto) for c in sums}})
    return inner.join(carried, [*keys, chunk]).select(
        *df.columns, F.coalesce("_lag", "_before").alias("before"), *[(F.col(f"_run_{c}") + F.col(f"_off_{c}")).alias(f"upto_{c}") for c in sums]
    )


def row_numbers(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], out: str = "rn") -> DataFrame:
    """Dense 1-based row number within the key."""
    return running_sum(df, keys, chunk, order, F.lit(1), out)
