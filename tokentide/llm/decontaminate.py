"""Benchmark passages in documents: SimHash of item-sized windows, Hamming look-up, exact similarity.

Words are lower-cased (A-Z). An item of n words is compared with every window of n words (the whole document, if it has
fewer) that shares a shingle with an item of that size; without a shared shingle the similarity is zero. Windows and
items have 128-bit SimHash fingerprints of their shingles, weighted by their counts. The fingerprint is cut into 16 bytes; two
fingerprints within `RADIUS` bits agree in one of the bytes up to RADIUS // 16 bits, so looking up every byte's
neighbourhood finds all items within the radius. These are verified by weighted Jaccard similarity of the shingle counts,
sum of minima over sum of maxima, at `PERCENT` or more.

The benchmark is a query set: it is read in blocks of `ITEMS_PER_BLOCK` items, whatever its size, and every block
meets all documents where they lie, without a shuffle.

Defined cases: null and wordless texts and items match nothing; an item of fewer than five words is one shingle; repeated
documents or items give a row each; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.words import Words, mix, pieces, window_hash

SHINGLE = 5
PERCENT = 75
BYTES = 16
# Similarity 0.75 has a mean distance of 22 bits with a deviation of 4.3; the radius is four deviations above.
RADIUS = 39
ITEMS_PER_BLOCK = 2000
_FILTER_BITS = 20


def bits(hashes: np.ndarray) -> np.ndarray:
    """128 pseudo-random bits per shingle."""
    both = np.stack([mix(hashes), mix(hashes ^ np.uint64(0x9FB21C651E98DF25))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), BYTES), axis=1)


def fingerprints(ones: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the fingerprints from the number of ones per bit and the number of shingles."""
    return np.packbits(2 * ones > size[:, None], axis=1)


class Items:
    """Items of one word count: their fingerprints, shingle counts and the look-up of near bytes."""

    def __init__(self, size: int, ids: list[int], hashes: list[np.ndarray]):
        self.size, self.width, self.ids = size, min(SHINGLE, size), ids
        counted = [np.unique(h, return_counts=True) for h in hashes]
        self.shingles, self.counts = [c[0] for c in counted], [c[1] for c in counted]
        self.known = np.unique(np.concatenate(self.shingles))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        n = np.array([len(h) for h in hashes])
        self.prints = fingerprints(np.stack([bits(h).sum(axis=0) for h in hashes]), n)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BYTES
        self.tables = [near[:, self.prints[:, b]] for b in range(BYTES)]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == hashes[maybe]]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = np.zeros((len(prints), len(self.ids)), bool)
        for b, table in enumerate(self.tables):
            found |= table[prints[:, b]]
        window, item = np.nonzero(found)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        close = distance <= RADIUS
        return window[close], item[close]


def item_sets(ids: list[int], texts: list[str]) -> list[Items]:
    w = Words(pa.array(texts, pa.string()), lower=True)
    hashes = w.hashes()
    by_size: dict[int, list[int]] = {}
    for k, n in enumerate(w.count):
        if n:
            by_size.setdefault(int(n), []).append(k)
    return [
        Items(n, [ids[k] for k in group], [window_hash(hashes[w.first[k] : w.first[k + 1]], min(SHINGLE, n)) for k in group])
        for n, group in sorted(by_size.items())
    ]


def _windows(w: Words, items: Items, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of shingles of the windows that hold a hit."""
    doc = w.doc[hit]
    short = w.count[doc] < items.size
    first, last = w.first[doc], w.first[doc + 1]
    whole = np.unique(doc[short])
    lo = np.maximum(first, hit - (items.size - items.width))[~short]
    hi = np.minimum(hit, last - items.size)[~short]
    change = np.bincount(lo, minlength=len(w.start) + 2)
    change -= np.bincount(hi + 1, minlength=len(w.start) + 2)
    starts = np.flatnonzero(np.cumsum(change) > 0)
    begin = np.concatenate([starts, w.first[whole]])
    size = np.concatenate([np.full(len(starts), items.size), w.count[whole]])
    return begin, size - items.width + 1


def _search(w: Words, hashes: dict[int, np.ndarray], items: Items) -> list[tuple[int, int, int, float]]:
    """(document row, item, first word, similarity) of each item's best window in each document."""
    shingles = hashes[items.width]
    hit = items.hits(shingles)
    if len(hit):
        whole = np.minimum(hit + items.width - 1, len(w.doc) - 1)
        hit = hit[w.doc[hit] == w.doc[whole]]
    if not len(hit):
        return []
    begin, size = _windows(w, items, hit)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for part in range(0, len(begin), 4096):
        b, n = begin[part : part + 4096], size[part : part + 4096]
        change = np.bincount(b, minlength=len(shingles) + 1)
        change -= np.bincount(b + n, minlength=len(shingles) + 1)
        used = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        ones = np.zeros((len(used) + 1, 8 * BYTES), np.int32)
        np.cumsum(bits(shingles[used]), axis=0, out=ones[1:])
        at = np.searchsorted(used, b)
        window, item = items.near(fingerprints(ones[at + n] - ones[at], n))
        for k, i in zip(window.tolist(), item.tolist(), strict=True):
            similarity = _similarity(shingles[b[k] : b[k] + n[k]], items.shingles[i], items.counts[i])
            if similarity * 100 >= PERCENT:
                doc = int(w.doc[b[k]])
                best[doc, i] = max(best.get((doc, i), (0.0, 0)), (similarity, int(w.first[doc] - b[k])))
    return [(doc, items.ids[i], -start, similarity) for (doc, i), (similarity, start) in best.items()]


def _similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
    values, n = np.unique(window, return_counts=True)
    _, x, y = np.intersect1d(values, shingles, assume_unique=True, return_indices=True)
    least = np.minimum(n[x], counts[y]).sum()
    return float(least / (n.sum() + counts.sum() - least))


def _matches(ids: list[int], texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = item_sets(ids, texts)
        for batch in batches:
            for piece in pieces(batch):
                w = Words(piece.column("text"), lower=True)
                plain = w.hashes()
                hashes = {k: window_hash(plain, k) for k in {g.width for g in groups}}
                rows = [r for g in groups for r in _search(w, hashes, g)]
                doc, item, start, similarity = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(doc, pa.int64())), piece.column("text_hash").take(pa.array(doc, pa.int64())),
                     pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(similarity, pa.float64())],
                    names=["doc_id", "text_hash", "item_id", "first_word", "similarity"],
                )

    return run


_OUT = "doc_id long, text_hash long, item_id long, first_word int, similarity double"


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, item_id, first_word, similarity): each item's best window in each document that holds it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("words")).where("words is not null")
    blocks = -(-items.count() // ITEMS_PER_BLOCK)
    if blocks > 1:
        items = items.withColumn("block", F.ntile(blocks).over(Window.orderBy("item", "words"))).persist()
    found = []
    for k in range(blocks):
        block = (items.where(F.col("block") == k + 1) if blocks > 1 else items).collect()
        found.append(rows.mapInArrow(_matches([r.item for r in block], [r.words for r in block]), _OUT))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _OUT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item; all columns stay."""
    leaked = matches(docs, benchmark).select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(leaked, docs["doc_id"].cast("long").eqNullSafe(leaked["l_id"]) & (own == leaked["l_hash"]), "left_anti")
