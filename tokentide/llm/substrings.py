"""Removal of word windows that occur more than once, by level-wise doubling.

Windows of a quarter of the wanted length come first. At each level the windows still under consideration are hashed and
counted over all documents; those that occur once are dropped, and what is repeated is extended to twice
the length, until the wanted length is reached or no candidate survives. Below the wanted length a repeated
window of full length needs only one repeated part, so a level looks at the part with the least hash in each window of full
length: equal windows choose equal parts. The last level looks at every remaining window.

Documents with equal word sequences are one class and enter the levels once; a class of several documents loses all
words of its windows. Groups are counted with partial aggregates before the shuffle and joined back as a semi-join,
so a passage of a third of all rows stays spread. Nothing is broadcast: Spark would size staged tables by their compressed
files, and spans of under 10 MB there took 271 MB on the driver.

Defined cases: a null text has no words; every row is a document of its own, also under a repeated or
null id; texts shorter than a window keep everything; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.anchors import anchors
from tokentide.llm.words import Words, covered, mix, pieces, window_hash
from tokentide.session import stage

WIDTH = 35
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words = [(t or "").encode().split() for t in piece.column("text").to_pylist()]
            joined = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()), pa.array([j.decode() for j in joined], pa.string())],
                names=["doc_id", "n_words", "digest", "text"],
            )


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digest, "doc_id long, n_words long, digest binary, text string")


def _emit(width: int, length: int):
    """Map of (rep, text, spans) to (key, proof, rep, lo, hi): hashed parts of `length` and the window starts they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield _parts(piece, width, length)

    return run


def _parts(piece: pa.RecordBatch, width: int, length: int) -> pa.RecordBatch:
    w = Words(piece.column("text"))
    n = len(w.start)
    hashes = w.hashes()
    keys = window_hash(hashes, length)
    # A start is wanted if a whole window of the document begins there and earlier levels left it.
    wanted = np.zeros(n, bool)
    begins = np.arange(max(0, n - width + 1))
    wanted[begins] = w.doc[begins] == w.doc[begins + width - 1] if len(begins) else False
    if "spans" in piece.schema.names:
        spans = piece.column("spans")
        flat = spans.flatten()
        rows = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        lo = flat.field("lo").to_numpy() + w.first[rows]
        hi = flat.field("hi").to_numpy() + w.first[rows]
        change = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi + 1, minlength=n + 1)[: n + 1]
        wanted &= np.cumsum(change)[:n] > 0
    at, lo, hi = anchors(keys, width - length + 1, wanted)
    doc = w.doc[lo] if len(lo) else np.zeros(0, np.int64)
    proof = (mix(window_hash(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), length)[at]) >> np.uint64(33)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[at].view(np.int64)), pa.array(proof), piece.column("rep").take(pa.array(doc)),
         pa.array((lo - w.first[doc]).astype(np.int32)), pa.array((hi - w.first[doc]).astype(np.int32))],
        names=["key", "proof", "rep", "lo", "hi"],
    )


_PART = "key long, proof int, rep long, lo int, hi int"


def lengths(width: int) -> list[int]:
    """Window lengths of the levels: halves rounded up, from about a quarter to the whole."""
    found = [width]
    while len(found) < 3 and found[0] > 4:
        found.insert(0, (found[0] + 1) // 2)
    return found


def repeated_spans(reps: DataFrame, width: int) -> DataFrame:
    """(rep, spans): the starts of windows of `width` words that occur at two places at least, over (rep, text)."""
    state = reps
    for length in lengths(width):
        parts = state.mapInArrow(_emit(width, length), _PART)
        # Written, so that both sides of the semi-join are plain shuffles and hot parts can be split.
        again = stage(parts.groupBy("key", "proof").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "proof"), "again")
        spans = (
            parts.join(again.hint("merge"), ["key", "proof"], "left_semi")
            .groupBy("rep")
            .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        )
        spans = stage(spans, f"spans{length}")
        if length < width:
            state = stage(reps.join(spans.hint("merge"), "rep"), f"level{length}")
    return spans


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                removed, shas, texts = [], [], []
                for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans"), strict=True):
                    words = np.array(text.encode().split(), dtype=object)
                    flat = spans.values
                    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
                    gone = covered(len(words), starts, width)
                    left = b" ".join(words[~gone])
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("digest"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                    names=["digest", "removed", "sha", "left"],
                )

    return run


def removed_windows(
    docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; `with_text` adds the kept words (`kept_text`)."""
    found = _documents(docs, id_col, text_col)
    reps = stage(
        found.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("text").alias("text"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    long = reps.where(F.col("n_words") >= width)
    spans = repeated_spans(long.select("rep", "text"), width)
    alone = long.where("copies = 1").select("rep", "digest", "text").join(spans.hint("merge"), "rep")
    kept = alone.mapInArrow(_kept(width), "digest binary, removed long, sha string, left string")
    copied = long.where("copies > 1").select(
        "digest", F.col("n_words").alias("removed"), F.lit(_EMPTY).alias("sha"), F.lit("").alias("left")
    )
    changed = kept.unionByName(copied)
    if not with_text:
        found, changed = found.drop("text"), changed.drop("left")
    out = found.join(changed.hint("merge"), "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", F.lower(F.hex("digest"))).alias("kept_sha256"),
        *([F.coalesce("left", "text").alias("kept_text")] if with_text else []),
    )
    return out
