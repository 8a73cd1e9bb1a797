"""Removal of byte strings that an earlier document holds, found with run-length compressed indexes.

A string of `width` bytes is removed where it also starts in a document with a smaller id. The corpus is dealt to
indexes by content: the least hash of the 16-byte grams (longer ones for widths above 77) in each window of `width` bytes is its anchor, so equal
windows have equal anchors. Anchors of one document alone are dropped after a count with partial aggregates. For each other
anchor the stretch of text with its windows (its context) is kept once per distinct content, with its smallest document. Contexts
of one anchor go to one index: a run-length Burrows-Wheeler transform with sampled run ends. All contexts are
streamed through it; where the match is `width` long or longer, the rows around it that share the window give its
smallest document. What a context learns goes to every document that holds it.

An anchor with more than `FULL` distinct contexts (the edge of a passage that very many documents share) would fill one
index. Its contexts are cut into their single windows, and these are counted over all documents.

Documents with equal texts are one class. Its smallest document stands for it, the others lose all windows.

Defined cases: a null text is empty; a document with a null id has no place in the order: it loses nothing and removes nothing; rows with
equal ids don't remove each other's text, whatever it is; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm.anchors import anchors
from tokentide.llm.rindex import RunIndex
from tokentide.llm.words import _VALUES, buffers, covered, pieces, repeated, window_sums
from tokentide.session import stage, unstage

WIDTH = 50
GRAM = 16
# Window starts of one anchor, a bit each.
MOST_STARTS = 62
FULL = 4096
# Bytes of contexts per index, more if one anchor has more.
INDEX_BYTES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()),
             pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), batch.column("text")],
            names=["doc_id", "n_bytes", "digest", "text"],
        )


class Anchors:
    """Anchors of the windows of each row's bytes: hash, row, first and last window start within the row."""

    def __init__(self, column: pa.Array, width: int):
        self.width, self.gram = width, min(width, max(GRAM, width - MOST_STARTS + 1))
        self.data, self.offset = buffers(column)
        keys = window_sums(_VALUES[self.data], self.gram)
        row = np.repeat(np.arange(len(column)), np.diff(self.offset))
        n = max(0, len(self.data) - width + 1)
        wanted = row[:n] == row[width - 1 :]
        at, self.lo, self.hi = anchors(keys, width - self.gram + 1, wanted)
        self.key, self.row = keys[at], row[self.lo] if len(at) else np.zeros(0, np.int64)

    def contexts(self, chosen: np.ndarray) -> pa.Array:
        """The bytes of all windows of the chosen anchors."""
        lo, size = self.lo[chosen], self.hi[chosen] - self.lo[chosen] + self.width
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(at[-1]) - np.repeat(at[:-1] - lo, size)
        data = self.data[place]
        return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                a = Anchors(piece.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.key.view(np.int64)), piece.column("least").take(pa.array(a.row))], names=["key", "doc"]
                )

    return run


def _places(width: int):
    """As `_keys`, with the class and the number of the anchor in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                a = Anchors(piece.column("text"), width)
                number = np.arange(len(a.row)) - np.searchsorted(a.row, a.row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.key.view(np.int64)), piece.column("cid").take(pa.array(a.row)), pa.array(number.astype(np.int32))],
                    names=["key", "cid", "number"],
                )

    return run


def _contexts(width: int):
    """Map of (cid, least, text, numbers) to the contexts of the numbered anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                a = Anchors(piece.column("text"), width)
                numbers = piece.column("numbers")
                rows = np.repeat(np.arange(len(piece)), np.diff(numbers.offsets.to_numpy()))
                chosen = np.searchsorted(a.row, rows) + numbers.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.key[chosen].view(np.int64)), a.contexts(chosen), piece.column("cid").take(pa.array(rows)),
                     piece.column("least").take(pa.array(rows)), pa.array((a.lo[chosen] - a.offset[rows]).astype(np.int32))],
                    names=["key", "context", "cid", "doc", "lo"],
                )

    return run


_CONTEXT = "key long, context binary, cid long, doc long, lo int"


def earlier(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each string a bit per window start: whether a string of a smaller document holds that window."""
    bits = np.zeros(len(doc), np.int64)
    some = np.flatnonzero(_with_company(data, offsets, width))
    if not len(some):
        return bits
    size = np.diff(offsets)[some]
    at = np.concatenate([[0], np.cumsum(size)])
    data = data[np.arange(at[-1]) - np.repeat(at[:-1] - offsets[some], size)]
    index = RunIndex(data, at)
    group = index.groups(width)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(doc[some][index.string[index.order]], first)
    for step, strings, rows, length in index.stream(data, at):
        long = length >= width
        s = strings[long]
        found = least[group[rows[long]]] < doc[some[s]]
        bits[some[s[found]]] |= np.int64(1) << (size[s[found]] - 1 - step)
    return bits


def _with_company(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Strings that hold a window whose hash occurs twice; the others can't match and needn't be indexed."""
    h = window_sums(_VALUES[data], width)
    string = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(string[: len(h)] == string[width - 1 :][: len(h)])
    again = repeated(h[whole])
    return np.bincount(string[whole[again]], minlength=len(offsets) - 1) > 0


def _indexed(width: int):
    """Map of (key, context, doc), sorted by key, to (key, proof, doc, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("context").nbytes
            if size > INDEX_BYTES:
                yield from _cut(held, width, last=False)
                size = held[0].column("context").nbytes if held else 0
        if held:
            yield from _cut(held, width, last=True)

    return run


def _cut(held: list[pa.RecordBatch], width: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Index all keys that are complete; what may go on stays in `held`."""
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(map(len, held)) else held[0]
    key = table.column("key").to_numpy()
    at = 0
    while at < len(key):
        data, off = buffers(table.column("context").slice(at))
        to = at + max(1, int(np.searchsorted(off, INDEX_BYTES, side="right")) - 1)
        to = int(np.searchsorted(key, key[to - 1], side="right")) if to < len(key) else len(key)
        if to == len(key) and not last:
            begin = int(np.searchsorted(key, key[-1]))
            held[:] = [table.slice(at)]
            if begin == at:
                return
            to = begin
        part = table.slice(at, to - at)
        data, off = buffers(part.column("context"))
        bits = earlier(data, off, part.column("doc").to_numpy(), width)
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("proof"), part.column("doc"), pa.array(bits)], names=["key", "proof", "first", "bits"]
        )
        at = to
        held[:] = [table.slice(at)]
    held[:] = []


def _forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results have been written."""
    spark.sparkContext._jvm.System.gc()


def candidates(reps: DataFrame, width: int = WIDTH) -> DataFrame:
    """Classes (cid, least, text) with the numbers of their anchors that documents of other ids hold too; staged."""
    spark = reps.sparkSession
    shared = (
        reps.select("least", "text")
        .mapInArrow(_keys(width), "key long, doc long")
        .groupBy("key")
        .agg(F.min("doc").alias("x"), F.max("doc").alias("y"))
        .where("x < y")
        .select("key")
    )
    shared = stage(shared, "anchors")
    _forget(spark)
    numbered = (
        reps.select("cid", "text")
        .mapInArrow(_places(width), "key long, cid long, number int")
        .join(shared, "key", "left_semi")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    )
    numbered = stage(numbered, "numbers")
    unstage(shared)
    _forget(spark)
    chosen = stage(reps.select("cid", "least", "text").join(numbered, "cid"), "chosen")
    unstage(numbered)
    _forget(spark)
    return chosen


def repeated_starts(chosen: DataFrame, width: int = WIDTH) -> DataFrame:
    """(cid, spans) of candidates: (start, bits) of the windows that a smaller document holds; staged."""
    spark = chosen.sparkSession
    held = chosen.mapInArrow(_contexts(width), _CONTEXT)
    distinct = stage(
        held.groupBy("key", "context")
        .agg(F.min("doc").alias("doc"), (F.min("doc") < F.max("doc")).alias("several"))
        .withColumn("proof", F.xxhash64("context")),
        "contexts",
    )
    _forget(spark)
    sizes = stage(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    many = sizes.where(F.col("n") > FULL).select("key")
    overfull = not many.isEmpty()

    # A context that is alone with its anchor has nothing to match but itself.
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    matched = (
        distinct.select("key", "context", "doc", "proof")
        .join(sizes.where(F.col("n") <= FULL).select("key"), "key", "left_semi")
        .repartition(blocks, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_indexed(width), "key long, proof long, first long, bits long")
    )
    known = stage(matched.where("bits <> 0"), "matched")
    # Only these contexts remove anything: several documents hold them, or a smaller one holds a window of theirs.
    firsts = (
        distinct.select("key", "proof", F.col("doc").alias("first"), "several")
        .join(known.select("key", "proof", "bits"), ["key", "proof"], "left")
        .where("several OR bits IS NOT NULL")
        .select("key", "proof", "first", F.coalesce("bits", F.lit(0)).alias("bits"))
    )
    firsts = stage(firsts.join(many, "key", "left_anti") if overfull else firsts, "firsts")
    unstage(distinct, known)
    _forget(spark)
    # The place and the number of starts share one number: a shuffle of all contexts carries them.
    light = held.select(
        "key",
        F.xxhash64("context").alias("proof"),
        "cid",
        "doc",
        (F.col("lo").cast("long") * 64 + F.octet_length("context") - width + 1).alias("place"),
    )
    every = F.expr("shiftleft(1L, cast(place % 64 as int)) - 1")
    marks = (
        light.join(firsts, ["key", "proof"])
        .select(
            "cid",
            F.expr("cast(place div 64 as int)").alias("lo"),
            F.when(F.col("doc") > F.col("first"), every).otherwise(F.col("bits")).cast("long").alias("bits"),
        )
        .where("bits <> 0")
    )
    marks = stage(marks, "windows")
    unstage(firsts)
    _forget(spark)
    if overfull:
        # A step of its own, so that the shuffles of the one before can go.
        single = stage(_single_windows(held.join(stage(many, "full"), "key", "left_semi"), width), "single")
        _forget(spark)
        marks = marks.unionByName(single)
    return stage(marks.groupBy("cid").agg(F.collect_list(F.struct("lo", "bits")).alias("spans")), "marks")


def _single_windows(held: DataFrame, width: int) -> DataFrame:
    """(cid, lo, bits) of the windows of contexts that a smaller document holds, each window counted over all documents.

    Windows are told apart by 128 bits of hashes.
    """
    starts = F.sequence(F.lit(1), F.octet_length("context") - width + 1)
    window = lambda k: F.substring("context", k, F.lit(width))
    hashes = F.transform(starts, lambda k: F.struct(F.xxhash64(window(k)).alias("x"), F.xxhash64(window(k), F.lit(1)).alias("y")))
    cut = held.select("cid", "doc", "lo", F.posexplode(hashes).alias("k", "w")).select(
        "cid", "doc", (F.col("lo") + F.col("k")).alias("lo"), "w.x", "w.y"
    )
    least = cut.groupBy("x", "y").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    return (
        cut.join(least, ["x", "y"])
        .where(F.col("doc") > F.col("first"))
        .select("cid", "lo", F.lit(1).cast("long").alias("bits"))
    )


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                removed, spans, shas, kept = [], [], [], []
                for text, marks in zip(piece.column("text"), piece.column("spans"), strict=True):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    lo, bits = marks.values.field("lo").to_numpy(), marks.values.field("bits").to_numpy()
                    flags = (bits[:, None] >> np.arange(MOST_STARTS)) & 1
                    row, k = np.nonzero(flags)
                    gone = covered(len(raw), lo[row] + k, width)
                    left = raw[~gone].tobytes()
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    shas.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("cid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()),
                     pa.array(kept, pa.binary())],
                    names=["cid", "removed", "spans", "sha", "kept"],
                )

    return run


def without_repeats(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; `with_bytes` adds the remaining bytes (`kept`)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_digest, "doc_id long, n_bytes long, digest binary, text string")
    named = found.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= width))
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    reps = stage(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")
    _forget(spark)
    named = stage(reps.select("digest", "least", "cid"), "named")
    chosen = candidates(reps.select("cid", "least", "text"), width)
    unstage(reps)
    marks = repeated_starts(chosen, width)
    _forget(spark)
    kept = chosen.select("cid", "text").join(marks, "cid").mapInArrow(
        _kept(width), "cid long, removed long, spans long, sha string, kept binary"
    )
    kept = stage(kept if with_bytes else kept.drop("kept"), "kept")
    _forget(spark)
    unstage(chosen)
    changed = named.join(kept, "cid", "left").drop("cid")
    members = found if with_bytes else found.drop("text")
    copy = F.col("doc_id") > F.col("least")
    first = F.col("doc_id") == F.col("least")

    def pick(copied, own, else_):
        return F.when(copy, copied).when(first & F.col("sha").isNotNull(), own).otherwise(else_)

    out = members.join(changed, "digest", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(_EMPTY), F.col("sha"), F.lower(F.hex("digest"))).alias("kept_sha256"),
        *([pick(F.lit(b""), F.col("kept"), F.coalesce("text", F.lit("")).cast("binary")).alias("kept")] if with_bytes else []),
    )
