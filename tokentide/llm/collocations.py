"""Phrase collocations by weighted acyclic automata.

1. Texts are cut into shards of about `SHARD_BYTES`; each keeps its words as numbers of its own sorted vocabulary.
2. Word counts are summed over all shards. Only words that occur often enough can stand in a phrase; they get numbers in
   (language, word) order, cut into prefix ranges of about `range_words` occurrences. A word with more is a range by
   itself, split further by a hash of the two words after it; its phrases of two words are counted apart, split by the second.
3. Every shard sorts its runs of up to four frequent words and builds a count transducer from them, cut by prefix range.
4. The transducers of a range are united and their weights summed: the counts of all phrases that begin in the range.
5. Parts of phrases are looked up by composing an automaton of the wanted parts with the count transducer.
6. Phrases inside a longer one that is nearly as frequent go; the best of each language stay.

Shards receive the numbers of their own words only, and nothing is collected on the driver. A frequent word is one row per shard, and
its phrases are spread over splits.

Defined cases: a null text is empty; a null language is `und`; an empty language is a language of its own; rows that repeat an id
count each; a text may be longer than a shard. Texts without a frequent phrase give no rows, and so does an empty table. Ties are
ordered by the phrase's UTF-8 bytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.automata import Counts
from tokentide.llm.words import LOWER, buffers, mix
from tokentide.session import stage

SHARD_BYTES = 1 << 23
SLICE_BYTES = 1 << 21
RANGE_WORDS = 1 << 20
LONGEST = 4
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_STOP[0x0A:0x0E] = True
_GAP = _STOP.copy()
_GAP[[0x09, 0x20]] = True


def _tokens(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a byte string, where they begin, and whether each is the first of its piece."""
    gap = _GAP[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    stops = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_STOP[data], out=stops[1:])
    new = np.ones(len(start), bool)
    new[1:] = stops[start[1:]] != stops[end[:-1]]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
    return words, start, new


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and lower-cased bytes of each text, closed by a line feed, a stop; long texts in parts that end behind a stop."""
    data, off = buffers(column)
    for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while a < b:
            to, stops = min(a + most, b), None
            while to < b and not len(stops := np.flatnonzero(_STOP[data[a:to]])):
                to = min(to + most, b)
            if to < b:
                to = a + int(stops[-1]) + 1
            yield row, np.append(LOWER[data[a:to]], np.uint8(10))
            a = to


class _Shard:
    """Words of many texts with their languages, until they are many enough."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.new: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.names: dict[str, int] = {}
        self.waiting: list[tuple[np.ndarray, int]] = []
        self.bytes = self.waiting_bytes = 0

    def add(self, part: np.ndarray, lang: str) -> None:
        self.waiting.append((part, self.names.setdefault(lang, len(self.names))))
        self.waiting_bytes += len(part)
        self.bytes += len(part)
        if self.waiting_bytes > SLICE_BYTES:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            words, start, new = _tokens(np.concatenate([p for p, _ in self.waiting]))
            owner = np.searchsorted(np.cumsum([len(p) for p, _ in self.waiting]), start, side="right")
            self.words.append(words.dictionary_encode())
            self.new.append(new)
            self.lang.append(np.array([n for _, n in self.waiting], np.int64)[owner])
        self.waiting, self.waiting_bytes = [], 0

    def row(self, number: int) -> pa.RecordBatch:
        self._count()
        coded = pa.chunked_array(self.words).unify_dictionaries() if self.words else pa.chunked_array([pa.array([], pa.binary()).dictionary_encode()])
        names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
        new = np.concatenate(self.new or [np.zeros(0, bool)])
        lang = np.concatenate(self.lang or [np.zeros(0, np.int64)])
        pairs, local, count = np.unique(lang * max(1, len(names)) + codes, return_inverse=True, return_counts=True)
        # A zero before each piece.
        at = np.arange(len(codes)) + np.cumsum(new)
        stream = np.zeros(len(codes) + int(new.sum()), np.int32)
        stream[at] = local + 1
        langs = pa.array(list(self.names), pa.string()).take(pa.array(pairs // max(1, len(names))))
        words = names.take(pa.array(pairs % max(1, len(names))))
        vocabulary = pa.StructArray.from_arrays([langs, words, pa.array(count)], ["lang", "word", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), vocabulary),
             pa.array([len(stream)], pa.int64()), pa.array([pa.compress(stream.tobytes(), codec="zstd", asbytes=True)], pa.binary())],
            names=["shard", "vocabulary", "length", "stream"],
        )


_SHARD = "shard long, vocabulary array<struct<lang: string, word: binary, n: long>>, length long, stream binary"


def _encoded(shard_bytes: int, slice_bytes: int):
    """Map of (text, lang) to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard, made = _Shard(), 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for k, part in _slices(batch.column("text"), slice_bytes):
                shard.add(part, langs[k])
                if shard.bytes >= shard_bytes:
                    yield shard.row(first + made)
                    shard, made = _Shard(), made + 1
        if shard.bytes:
            yield shard.row(first + made)
        # Workers are reused: what the task no longer needs goes back.
        del shard
        pa.default_memory_pool().release_unused()

    return run


def _numbered(range_words: int):
    """Map of sorted (lang, word, f) to their numbers, the range in the upper half, and the splits of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, held, inside = (TaskContext.get().partitionId() + 1) << 20, 0, 0
        for batch in batches:
            numbers, splits = [], []
            for f in batch.column("f").to_pylist():
                if held and held + f > range_words:
                    prefix, held, inside = prefix + 1, 0, 0
                held, inside = held + f, inside + 1
                numbers.append((prefix << 24) + inside)
                splits.append(-(-f // range_words))
                if inside == (1 << 24) - 1:
                    held = range_words
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64()), pa.array(splits, pa.int32())], names=[*batch.schema.names, "id", "splits"]
            )

    return run


_BLOB = "prefix long, split int, splits int, automaton binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map of (length, stream, numbers) to the count transducers of a shard, one per prefix range and split."""
    for batch in batches:
        for k in range(len(batch)):
            length = batch.column("length")[k].as_py()
            raw = pa.decompress(batch.column("stream")[k].as_buffer(), decompressed_size=4 * length, codec="zstd")
            numbers = batch.column("numbers").slice(k, 1).flatten()
            yield from _transducers(np.frombuffer(raw, np.int32), *(numbers.field(c).to_numpy().astype(np.int64) for c in ("local", "id", "splits")))


def _transducers(stream: np.ndarray, local: np.ndarray, ids: np.ndarray, splits: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids)
    local, ids, splits = local[order], ids[order], splits[order]
    # Frequent words by rank of their number; what is 0 ends a run.
    rank = np.zeros(int(max(stream.max(initial=0), local.max(initial=0))) + 2, np.int32)
    rank[local + 1] = np.arange(1, len(local) + 1)
    t = np.concatenate([rank[stream], np.zeros(LONGEST, np.int32)])
    at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
    if not len(at):
        return
    cols = [t[at], t[at + 1]]
    for d in range(2, LONGEST):
        cols.append(np.where(cols[-1] > 0, t[at + d], 0))
    del at
    many = splits[cols[0] - 1]
    prefix = ids >> 24
    # Cells in order of the ranges; a word with splits has two for each.
    base = np.concatenate([[True], prefix[1:] != prefix[:-1]])
    width = np.where(base, np.where(splits > 1, 2 * splits, 1), 0)
    cell = (np.cumsum(width) - np.where(base, width, 0))[np.maximum.accumulate(np.where(base, np.arange(len(ids)), 0))]
    number = np.concatenate([[0], ids])
    split, weight = np.zeros(len(many), np.int64), np.ones(len(many), np.int64)
    if (hot := np.flatnonzero(many > 1)).size:
        # Every phrase is counted in one cell: those of two words in the second half of the splits, longer ones in the first.
        pair, n = np.unique(cols[0][hot].astype(np.int64) * len(number) + cols[1][hot], return_counts=True)
        keep = np.flatnonzero((many == 1) | (cols[2] > 0))
        none = np.zeros(len(pair), np.int32)
        pairs = ((pair // len(number)).astype(np.int32), (pair % len(number)).astype(np.int32), none, none)
        cols = [np.concatenate([c[keep], p]) for c, p in zip(cols, pairs, strict=True)]
        weight = np.concatenate([weight[keep], n])
        many = splits[cols[0] - 1]
        second, third = (number[c].astype(np.uint64) for c in cols[1:3])
        split = (np.where(third > 0, mix(mix(second) + third), mix(second)) % many.astype(np.uint64)).astype(np.int64)
        split[len(keep) :] += many[len(keep) :]
    cells = cell[cols[0] - 1] + split
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0], cells))
    cells = cells[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])), len(cells))
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine = order[a:b]
        paths = number[np.stack([c[mine] for c in cols], axis=1)]
        automaton = Counts.from_sorted(paths, weight[mine]).to_bytes()
        found.append((int(paths[0, 0] >> 24), int(split[mine[0]]), int(many[mine[0]]), automaton))
    for a in range(0, len(found), 64):
        part = list(zip(*found[a : a + 64], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(part, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
            names=["prefix", "split", "splits", "automaton"],
        )


def _united(least: int):
    """Union of the transducers of one range and split: its phrases with their counts."""

    def run(table: pa.Table) -> pa.Table:
        whole = Counts.union([Counts.from_bytes(x.as_py()) for x in table.column("automaton")])
        split, splits = (table.column(c)[0].as_py() for c in ("split", "splits"))
        shortest, longest = (2, LONGEST) if splits == 1 else (3, LONGEST) if split < splits else (2, 2)
        phrases, counts = [], []
        for d in range(shortest, longest + 1):
            weight = whole.levels[d - 1].weight
            keep = np.flatnonzero(weight >= least)
            phrases += list(whole.paths(d)[keep])
            counts.append(weight[keep])
        return pa.table({"g": pa.array(phrases, pa.list_(pa.int64())), "a": pa.array(np.concatenate(counts), pa.int64())})

    return run


def _looked_up(counts: pa.Table, wanted: pa.Table) -> pa.Table:
    """The wanted parts with their counts: an automaton of the parts composed with the count transducer."""

    def automaton(table: pa.Table, weights: np.ndarray) -> tuple[Counts, np.ndarray]:
        lists = table.column("g").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        paths = np.zeros((len(sizes), LONGEST), np.int64)
        paths[np.arange(LONGEST) < sizes[:, None]] = lists.flatten().to_numpy()
        order = np.lexsort(paths.T[::-1])
        return Counts.from_sorted(paths[order], weights[order]), paths[order]

    if not len(counts) or not len(wanted):
        return pa.table({"g": pa.array([], pa.list_(pa.int64())), "f": pa.array([], pa.int64())})
    # A path's weight is its own count here, so states that only lead on weigh what follows: only whole paths are read.
    lists = counts.column("g").combine_chunks()
    found, sizes = [], pc.list_value_length(lists).to_numpy()
    asked = wanted.column("g").combine_chunks()
    asked_sizes = pc.list_value_length(asked).to_numpy()
    for d in np.unique(asked_sizes).tolist():
        mine, theirs = counts.filter(pa.array(sizes == d)), wanted.filter(pa.array(asked_sizes == d))
        if not len(mine):
            continue
        have, _ = automaton(mine, mine.column("a").to_numpy())
        want, paths = automaton(theirs, np.ones(len(theirs), np.int64))
        found.append((paths[:, :d], have.compose(want)[d - 1]))
    phrases = [row for paths, _ in found for row in paths]
    weights = np.concatenate([w for _, w in found]) if found else np.zeros(0, np.int64)
    return pa.table({"g": pa.array(phrases, pa.list_(pa.int64())), "f": pa.array(weights, pa.int64())})


def _parts(phrases: DataFrame) -> DataFrame:
    """(g, a, k, first, rest) for every cut of every phrase."""
    cuts = phrases.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    return cuts.withColumns({"first": F.slice("g", 1, F.col("k")), "rest": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})


def collocations(
    docs: DataFrame,
    least: int = 30,
    most: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    shard_bytes: int = SHARD_BYTES,
    slice_bytes: int = SLICE_BYTES,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of two to four words that occur `least` times."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = stage(rows.where("text <> ''").mapInArrow(_encoded(shard_bytes, slice_bytes), _SHARD), "shards")
    local = shards.select("shard", F.posexplode("vocabulary").alias("local", "v")).select("shard", "local", "v.*")
    counted = stage(local.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.where(F.col("f") >= least).orderBy("lang", "word")
    words = stage(frequent.mapInArrow(_numbered(range_words), "lang string, word binary, f long, id long, splits int"), "numbers")

    # Each shard gets the numbers of its own frequent words.
    numbers = local.drop("n").join(words.select("lang", "word", "id", "splits"), ["lang", "word"])
    numbers = numbers.groupBy("shard").agg(F.collect_list(F.struct(F.col("local").cast("long").alias("local"), "id", F.col("splits").cast("long").alias("splits"))).alias("numbers"))
    automata = shards.select("shard", "length", "stream").join(numbers, "shard").select("length", "stream", "numbers").mapInArrow(_built, _BLOB)
    phrases = stage(automata.groupBy("prefix", "split").applyInArrow(_united(least), "g array<long>, a long"), "phrases")

    # Counts of all parts.
    cuts = stage(_parts(phrases), "cuts")
    wanted = cuts.select(F.explode(F.array("first", "rest")).alias("g")).distinct()
    known = phrases.where(F.size("g") < LONGEST).unionByName(words.select(F.array("id").alias("g"), F.col("f").alias("a")))
    buckets = max(1, phrases.count() // 50_000)
    bucket = F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket")
    found = (
        known.select(bucket, "g", "a").groupBy("bucket").cogroup(wanted.select(bucket, "g").groupBy("bucket")).applyInArrow(_looked_up, "g array<long>, f long")
    )
    found = stage(found, "parts")
    scored = cuts.join(found.select(F.col("g").alias("first"), F.col("f").alias("l")), "first").join(
        found.select(F.col("g").alias("rest"), F.col("f").alias("r")), "rest"
    )
    exact = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (l + r)")
    scored = scored.groupBy("g", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("s"))

    # Phrases inside a longer one of at least 80 % of their count.
    longer = phrases.where("size(g) > 2").select(
        "a", F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), m -> transform(sequence(1, size(g) - m + 1), s -> slice(g, s, m))))")).alias("g")
    )
    longer = longer.groupBy("g").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, "g", "left").where(
        "longest IS NULL OR cast(100 as decimal(3, 0)) * cast(longest as decimal(19, 0)) < cast(80 as decimal(3, 0)) * cast(a as decimal(19, 0))"
    )
    lang = words.select(F.col("id").alias("head"), "lang")
    kept = kept.withColumn("head", F.element_at("g", 1)).join(lang, "head").select("lang", "g", "a", "s.score", "s.l", "s.r")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the last place stay until the phrases are spelled out.
    top = stage(kept.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= most), "top")
    spelled = top.select("g", F.posexplode("g").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("g", F.concat_ws(" ", F.transform("w", lambda w: w["word"].cast("string"))).alias("phrase"))
    out = top.join(spelled, "g").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
