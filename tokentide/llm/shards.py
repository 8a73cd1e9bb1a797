"""Shards of near-equal bytes from sampled splitters.

Records are ordered by (digest of the text, id). A size-weighted sample of their keys gives quantile
boundaries; the records are dealt into the ranges between them, ranges that turn out overfull are divided at keys of a further
sample, and running sums inside the ranges place every record at its byte offset in the whole order. A shard is an
equal share of the bytes. Records with equal texts are neighbours. Such a group goes undivided to the shard in which it
begins while it has at most `whole_share` of a shard's bytes; larger groups are divided.

Defined cases: a null text has no bytes and the checksum of the empty text; its size is 1 like that of an empty text; a null id sorts
first; repeated rows get slots of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.session import stage

# Expected sample keys per range. A range is sorted by one task; the driver holds SAMPLE_PER_RANGE keys of each.
SAMPLE_PER_RANGE = 24
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 2_000_000
OVERFULL = 2.0


def _sample(rows: DataFrame, total: int, keys: int, seed: int) -> pd.DataFrame:
    """About `keys` keys, each record drawn with probability size * keys / total (certain if that is above 1)."""
    draw = (F.xxhash64("key", "sub", "doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    return rows.where(draw < F.col("size") * float(keys) / float(total)).select("key", "sub", "size").toPandas()


def _quantiles(sample: pd.DataFrame, ranges: int, rate: float) -> list[tuple[str, int]]:
    """Keys at the weighted quantiles; a record above the sampling step counts with its size, others with the step."""
    ordered = sample.sort_values(["key", "sub"], kind="stable")
    weight = np.cumsum(np.maximum(ordered["size"].to_numpy(float), rate))
    if not len(weight):
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return sorted({(ordered["key"].iloc[i], int(ordered["sub"].iloc[i])) for i in at})


def _dealt(rows: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """Adds `part`: how many boundaries are at or before the record's key."""
    keys = np.array([k for k, _ in bounds], dtype=object)
    subs = np.array([s for _, s in bounds], dtype=np.int64)

    @F.pandas_udf("int")
    def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, sub in batches:
            found = np.searchsorted(keys, key.to_numpy(object), side="right") if len(keys) else np.zeros(len(key), int)
            low = np.searchsorted(keys, key.to_numpy(object), side="left") if len(keys) else found
            for i in np.flatnonzero(found > low):  # the key itself is a boundary: the second part decides
                found[i] = low[i] + np.searchsorted(subs[low[i] : found[i]], sub.iloc[i], side="right")
            yield pd.Series(found.astype(np.int32))

    return rows.withColumn("part", part("key", "sub"))


def _ranges(rows: DataFrame, total: int, ranges: int) -> tuple[DataFrame, pd.DataFrame]:
    """Records with their range, and bytes and records per range; overfull ranges are divided until none can be."""
    keys = SAMPLE_PER_RANGE * ranges
    bounds = _quantiles(_sample(rows, total, keys, 0), ranges, total / keys)
    for turn in range(1, 20):
        dealt = _dealt(rows, bounds)
        sums = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toPandas()
        full = sums[(sums["bytes"] > OVERFULL * total / ranges) & (sums["rows"] > 1)]
        if full.empty:
            break
        inside = dealt.where(F.col("part").isin([int(x) for x in full["part"]]))
        more = _quantiles(
            _sample(inside, int(full["bytes"].sum()), SAMPLE_PER_RANGE * ranges, turn), ranges, float(full["bytes"].sum()) / keys
        )
        wider = sorted({*bounds, *more})
        if wider == bounds:
            break
        bounds = wider
    return dealt, sums


def shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_share: float = 0.01,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every record; the law is `bytes`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
        ),
        "sizes",
    )
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # At most n_shards / whole_share groups are above this size, so their keys may be broadcast.
    large = (
        rows.groupBy("key")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > whole_share * total / n_shards)
        .select("key", F.lit(True).alias("large"))
    )
    # A divided group's members are ordered by id, an undivided one counts as one record.
    least = -(1 << 63)
    keyed = rows.join(F.broadcast(large), "key", "left").withColumn(
        "sub", F.when(F.col("large"), F.coalesce("doc_id", F.lit(least))).otherwise(F.lit(least))
    )
    ranges = max(n_shards * RANGES_PER_SHARD, n_rows // ROWS_PER_RANGE)
    dealt, sums = _ranges(keyed, total, ranges)
    sums = sums.sort_values("part")
    spark = docs.sparkSession
    before = spark.createDataFrame(
        [
            (int(p), int(b), int(r))
            for p, b, r in zip(sums["part"], sums["bytes"].cumsum() - sums["bytes"], sums["rows"].cumsum() - sums["rows"], strict=True)
        ],
        "part int, bytes_before long, rows_before long",
    )
    order = Window.partitionBy("part").orderBy("key", "sub")
    upto = F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("size").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", F.col("doc_id").asc_nulls_first()))
    placed = (
        dealt.withColumn("begin", upto - peers)
        .withColumn("rank", rank)
        .join(F.broadcast(before), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(
                F.lit(n_shards - 1), F.floor((F.col("bytes_before") + F.col("begin")) * n_shards / F.lit(max(total, 1)))
            ).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("rank") - 1).alias("place"),
        )
    )
    placed = stage(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
