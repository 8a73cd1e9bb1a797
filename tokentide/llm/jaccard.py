"""Links between documents whose sets of five-word shingles are similar, from blocked products of the incidence matrix.

Documents with equal sets are one class; classes are the rows of a sparse matrix, shingles its columns. A pair at
the threshold must share a column among the first n - ceil(t * n) + 1 of each row in any common order of the columns, so
only these entries are kept. The order begins with the columns in the first `FRONT` of all hashes, by their exact numbers of rows;
columns that a bounded sample shows to be common come last. It decides the work and never the result. All entries of front columns are
dealt to blocks of columns, where those of one row end; of the others each row drops its most common ones beyond its prefix, so a row whose
prefix is met nowhere else has none left. The rest is dealt to blocks again. Each task multiplies its
block with its transpose and adds up the overlaps of each pair of rows, without pairs whose sizes rule them out. Sums over
all blocks discard what cannot reach the overlap that the two sizes demand. Remaining pairs are verified on
their texts, each class's best partner first; later only pairs between different components count.

A column with more than `WIDE` rows isn't multiplied in full at first. In each of `TURNS` turns each row chooses a few of these columns,
which are multiplied with `PIVOTS` of their rows, and each row's best partner is verified. Once components are known, the rows outside the column's largest component are
multiplied with all. These rows carry a signature, the parities of their shingles in `SIGNATURE` buckets: two sets differ in at
least as many shingles as their signatures in bits, so most pairs that share a passage but don't link are dropped before they
are put out. A pair that is left is put out by the first column it shares alone. No link between components is lost.

Defined cases: a null or wordless text has no shingles and is alone; fewer than five words are one shingle; a
null id links like any other but is not named as a component unless all ids of it are null; repeated rows are equal sets; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.components import components
from tokentide.llm.words import Words, mix, pieces, span_hash
from tokentide.session import stage, unstage

SHINGLE = 5
PERCENT = 75
# Documents in the sample that orders the columns, and the count in it from which a column is common.
ORDER_SAMPLE = 16384
COMMON = 4
# Share of all columns that is ordered by exact counts; a prefix takes a quarter of a row.
FRONT = 0.375
WIDE = 64
PIVOTS = 4
# Wide columns of a row in which it looks for pivots in a turn.
CHOSEN = 6
SIGNATURE = 1024
TURNS = 3


class Sets:
    """Sorted distinct shingles of each row of a text column: `values[first[i]:first[i+1]]`."""

    def __init__(self, column: pa.Array):
        w = Words(column, lower=True)
        hashes = w.hashes()
        h, at = w.windows(hashes, SHINGLE)
        rows = w.doc[at]
        short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
        whole = span_hash(hashes, w.first[short], w.first[short + 1])
        place = np.searchsorted(rows, short)
        rows, h = np.insert(rows, place, short), np.insert(h, place, whole)
        # The rows are in order already, and each is short enough to be sorted by itself.
        ends = np.searchsorted(rows, np.arange(len(column) + 1)).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.row = h[new], rows[new]
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))
        self.count = np.diff(self.first)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            s = Sets(piece.column("text"))
            digests = [
                hashlib.blake2b(s.values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(s.first[:-1], s.first[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text_hash"), pa.array(s.count.astype(np.int64)), pa.array(digests, pa.binary()),
                 piece.column("text")],
                names=["doc_id", "text_hash", "n_shingles", "digest", "text"],
            )


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array(Sets(piece.column("text")).values.view(np.int64))], names=["shingle"])


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles that sets of sizes n and m need: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Entries of a row of n that must be looked at: any partner shares at least ceil(percent * n / 100)."""
    return n - -(-percent * n // 100) + 1


def _entries(common: np.ndarray, percent: int):
    """Map of (cid, text) to the front entries of each row and, if they are fewer than its prefix, the next ones: (shingle, cid, n, spare).

    `spare` is the number of front entries beyond the prefix.
    """
    front = np.uint64(int(FRONT * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = Sets(piece.column("text"))
                turn = (s.values >= front).astype(np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s.values), len(common) - 1)
                    turn[common[at] == s.values] = 2
                key = s.row * 3 + turn
                # Keys of 16 bits are sorted by their digits.
                order = np.argsort(key.astype(np.uint16) if 3 * len(piece) <= 1 << 16 else key, kind="stable")
                place = np.arange(len(order)) - s.first[s.row]
                heads = np.bincount(s.row[turn == 0], minlength=len(s.count))
                needed = prefix(s.count, percent)
                order = order[place < np.maximum(heads, needed)[s.row]]
                rows = s.row[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.values[order].view(np.int64)), piece.column("cid").take(pa.array(rows)),
                     pa.array(s.count[rows].astype(np.int32)), pa.array(np.maximum(heads - needed, 0)[rows].astype(np.int32))],
                    names=["shingle", "cid", "n", "spare"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a block in columns of several rows, with the column's size."""
    batches = list(batches)
    if batches:
        table = pa.Table.from_batches(batches)
        shingle = table.column("shingle").to_numpy()
        order = np.argsort(shingle)
        shingle = shingle[order]
        begin = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, len(shingle)))
        size = np.repeat(sizes, sizes)
        at = np.flatnonzero(size > 1)
        chosen = order[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingle[at]), *[pa.array(table.column(c).to_numpy()[chosen]) for c in ("cid", "n", "spare")],
             pa.array(size[at].astype(np.int64))],
            names=["shingle", "cid", "n", "spare", "size"],
        )


def _prefixes(texts: DataFrame, common: np.ndarray, percent: int, blocks: int) -> DataFrame:
    """(shingle, cid, n): entries of each row's prefix in columns of several rows."""
    entries = texts.select("cid", "text").mapInArrow(_entries(common, percent), "shingle long, cid long, n int, spare int")
    met = entries.repartition(blocks, "shingle").mapInArrow(_repeated, "shingle long, cid long, n int, spare int, size long")
    place = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("size"), F.desc("shingle")))
    return met.withColumn("place", place).where("place > spare").select("shingle", "cid", "n")


def _sorted_block(batches: Iterator[pa.RecordBatch], turn: int | None = None) -> tuple[np.ndarray, ...] | None:
    """Entries of a block by column; inside a column in any order, or in one of its own for each turn."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return None
    shingle = table.column("shingle").to_numpy()
    cid = table.column("cid").to_numpy()
    if turn is None:
        order = np.argsort(shingle)
    else:
        order = np.lexsort((mix(cid.view(np.uint64) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)), shingle))
    comp = table.column("comp").to_numpy()[order] if "comp" in table.schema.names else cid[order]
    shingle = shingle[order]
    begin = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    return shingle, cid[order], table.column("n").to_numpy()[order].astype(np.int64), comp, begin, np.append(begin[1:], len(shingle))


def _products(cid, n, comp, spans, percent: int, most: int | None, signs: np.ndarray | None = None):
    """Pairs of rows in each column span, without those of one component or of sizes or signatures that rule a link out."""
    for a, b in spans:
        m = b - a
        c, s, k = cid[a:b], n[a:b], comp[a:b]
        g = None if signs is None else signs[a:b]
        heads = m - 1 if most is None else min(most, m - 1)
        if g is not None and m > 2:
            # Rows of the largest component come last: they meet no other row of it.
            names, at, sizes = np.unique(k, return_inverse=True, return_counts=True)
            largest = at == sizes.argmax()
            order = np.argsort(largest, kind="stable")
            c, s, k = c[order], s[order], k[order]
            g = None if g is None else g[order]
            heads = min(heads, m - int(largest.sum()))
        for i in range(heads):
            fits = (100 * np.minimum(s[i], s[i + 1 :]) >= percent * np.maximum(s[i], s[i + 1 :])) & (k[i] != k[i + 1 :])
            j = np.flatnonzero(fits) + i + 1
            if g is not None and len(j):
                apart = np.bitwise_count(g[j] ^ g[i]).sum(axis=1, dtype=np.int64)
                j = j[(s[i] + s[j] - apart) // 2 >= least_overlap(s[i], s[j], percent)]
            if len(j):
                one, two = np.full(len(j), c[i]), np.full(len(j), s[i])
                turned = c[j] < c[i]
                yield np.where(turned, c[j], one), np.where(turned, one, c[j]), np.where(turned, s[j], two), np.where(turned, two, s[j])


def _summed(parts, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Overlaps per pair, summed in runs of at least `most` products."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield _sum(held)
            held, size = [], 0
    if held:
        yield _sum(held)


def _sum(held) -> pa.RecordBatch:
    a, b, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, n, m = a[order], b[order], n[order], m[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    counts = np.diff(np.append(new, len(a)))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[new]), pa.array(b[new]), pa.array(n[new].astype(np.int32)), pa.array(m[new].astype(np.int32)),
         pa.array(counts.astype(np.int32))],
        names=["a", "b", "n", "m", "overlap"],
    )


_PAIR = "a long, b long, n int, m int, overlap int"


def _narrow(percent: int):
    """Product of a block of narrow columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _sorted_block(batches)
        if block is not None:
            _, cid, n, comp, begin, end = block
            yield from _summed(_products(cid, n, comp, list(zip(begin, end, strict=True)), percent, None))

    return run


def _tops(percent: int, turn: int):
    """Product of a block of wide columns with `PIVOTS` rows of each, others in each turn, between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _sorted_block(batches, turn)
        if block is not None:
            _, cid, n, comp, begin, end = block
            yield from _summed(_products(cid, n, comp, list(zip(begin, end, strict=True)), percent, PIVOTS))

    return run


def _across(percent: int):
    """Pairs between rows of different components in a block of wide columns; a pair comes from the first column it shares.

    Rows carry their signatures and the sorted list of their columns in `met`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        block = _sorted_block(iter(batches))
        if block is not None:
            shingle, cid, n, comp, begin, end = block
            # The rows of a block are few beside its entries: a signature is held once a row.
            signs, met = {}, {}
            for batch in batches:
                for c, sign, m in zip(batch.column("cid").to_pylist(), batch.column("sign"), batch.column("met"), strict=True):
                    if c not in signs:
                        signs[c], met[c] = sign.as_py(), np.array(m.values)
            known = np.array(sorted(signs), np.int64)
            table = np.frombuffer(b"".join([signs[c] for c in known.tolist()]), np.uint64).reshape(len(known), -1)
            at = np.searchsorted(known, cid)
            yield from _summed(_firsts(shingle, cid, n, comp, list(zip(begin, end, strict=True)), percent, table, at, met))

    return run


def _firsts(shingle, cid, n, comp, spans, percent: int, table: np.ndarray, at: np.ndarray, met: dict[int, np.ndarray]):
    """Products of each span without the pairs that share an earlier column; once for each column that they share."""
    for a, b in spans:
        part = slice(a, b)
        for one, two, size, other in _products(cid[part], n[part], comp[part], [(0, b - a)], percent, None, table[at[part]]):
            shared = [np.intersect1d(met[x], met[y], assume_unique=True) for x, y in zip(one.tolist(), two.tolist(), strict=True)]
            times = np.array([len(x) if x[0] == shingle[a] else 0 for x in shared])
            if times.any():
                yield tuple(np.repeat(x, times) for x in (one, two, size, other))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sign): for each bucket of shingles whether the row has an odd number of them."""
    for batch in batches:
        for piece in pieces(batch):
            for a in range(0, len(piece), 512):
                part = piece.slice(a, 512)
                sets = Sets(part.column("text"))
                buckets = sets.row * SIGNATURE + (sets.values % np.uint64(SIGNATURE)).astype(np.int64)
                odd = (np.bincount(buckets, minlength=len(part) * SIGNATURE) & 1).astype(np.uint8).reshape(len(part), SIGNATURE)
                packed = np.packbits(odd, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([p.tobytes() for p in packed], pa.binary())], names=["cid", "sign"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text_a"):
                x, y = Sets(piece.column("text_a")), Sets(piece.column("text_b"))
                shared = np.array(
                    [
                        len(np.intersect1d(x.values[x.first[i] : x.first[i + 1]], y.values[y.first[i] : y.first[i + 1]], assume_unique=True))
                        for i in range(len(piece))
                    ],
                    np.int64,
                )
                linked = 100 * shared >= percent * (x.count + y.count - shared)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a"), piece.column("b"), pa.array(linked)], names=["a", "b", "linked"]
                )

    return run


def _possible(pairs: DataFrame, percent: int, unseen: DataFrame | None = None) -> DataFrame:
    """Pairs whose summed overlap and uncounted entries can still reach what their sizes demand.

    `unseen` (cid, wide) has the number of a row's entries in columns that weren't multiplied.
    """
    summed = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("overlap").alias("overlap"))
    more = F.lit(0)
    if unseen is not None:
        for side in ("a", "b"):
            summed = summed.join(unseen.select(F.col("cid").alias(side), F.col("wide").alias(f"wide_{side}")), side, "left")
        more = F.least(F.coalesce("wide_a", F.lit(0)), F.coalesce("wide_b", F.lit(0)))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100.0 + percent) - 1e-9)
    rest = F.greatest(*[F.floor(F.col(c) * percent / 100.0) + 1 for c in ("n", "m")])
    return summed.where(F.col("overlap") + more + rest >= need).select("a", "b", "overlap")


def _best(pairs: DataFrame) -> DataFrame:
    """Each row's pair of the greatest overlap."""
    each = pairs.select("a", F.col("b").alias("other"), "overlap").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("other"), "overlap")
    )
    best = each.groupBy("a").agg(F.max_by("other", F.struct("overlap", -F.col("other"))).alias("other"))
    return best.select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified links among pairs (a, b)."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    checked = joined.mapInArrow(_verify(percent), "a long, b long, linked boolean")
    return stage(checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")


def _across_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    named = comps.select(F.col("node"), F.col("component"))
    out = pairs.join(named.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        named.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left"
    )
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "overlap")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row with its class digest, and one row per class: (cid, doc_id, digest, text), both staged."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    # The sets are made once; the copy of the texts goes as soon as the classes have theirs.
    found = stage(rows.mapInArrow(_digest, "doc_id long, text_hash long, n_shingles long, digest binary, text string"), "digests")
    one = found.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    one = stage(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = stage(found.drop("text"), "members")
    unstage(found)
    return members, one


def class_components(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes (cid, text) that are linked with others."""
    spark = texts.sparkSession
    total = texts.count()
    rate = min(1.0, ORDER_SAMPLE / max(1, total))
    draw = F.xxhash64("cid").bitwiseAND(F.lit((1 << 32) - 1)) < int(rate * (1 << 32))
    sample = texts.where(draw).select("text").mapInArrow(_all, "shingle long")
    # At most ORDER_SAMPLE times a document's shingles over COMMON: bounded by the sample, not by the corpus.
    common = sample.groupBy("shingle").count().where(F.col("count") >= COMMON).select("shingle").toPandas()["shingle"]
    common = np.sort(common.to_numpy(np.int64).view(np.uint64))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    entries = _prefixes(texts, common, percent, blocks)
    column = Window.partitionBy("shingle")
    met = stage(entries.withColumn("size", F.count(F.lit(1)).over(column)).withColumn("least", F.min("cid").over(column)), "entries")
    wide = met.where(F.col("size") > WIDE).select("shingle", "cid", "n")
    unseen = wide.groupBy("cid").agg(F.count(F.lit(1)).alias("wide"))
    # Narrow columns of one group of copies mostly have the same least row: their products meet in one block.
    narrow = met.where((F.col("size") > 1) & (F.col("size") <= WIDE)).repartition(blocks, "least").select("shingle", "cid", "n")
    pairs = stage(_possible(narrow.mapInArrow(_narrow(percent), _PAIR), percent, unseen), "pairs")

    first = _best(pairs)
    comps = _grown(None, _linked(first, texts, percent))
    later = stage(_across_components(pairs, comps).join(first, ["a", "b"], "left_anti"), "later")
    comps = _grown(comps, _linked(later, texts, percent))
    if wide.isEmpty():
        return comps

    def between() -> DataFrame | None:
        """Wide columns with rows of several components, dealt to blocks; None if there are none."""
        named = stage(
            wide.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(
                "shingle", "cid", "n", F.coalesce("component", "cid").alias("comp")
            ),
            "wide",
        )
        mixed = named.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("shingle")
        mixed = stage(mixed, "mixed")
        return None if mixed.isEmpty() else named.join(mixed, "shingle", "left_semi")

    for turn in range(TURNS):
        columns = between()
        if columns is None:
            return comps
        # Near copies choose mostly the same few of their columns.
        choice = F.row_number().over(Window.partitionBy("cid").orderBy(F.xxhash64("shingle", F.lit(turn)), "shingle"))
        columns = columns.withColumn("choice", choice).where(F.col("choice") <= CHOSEN).drop("choice").repartition(blocks, "shingle")
        tops = columns.mapInArrow(_tops(percent, turn), _PAIR).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
        found = _linked(_best(stage(tops, "tops")), texts, percent)
        if found.isEmpty():
            break
        comps = _grown(comps, found)
    columns = between()
    if columns is None:
        return comps
    lists = columns.groupBy("cid").agg(F.sort_array(F.collect_list("shingle")).alias("met"))
    signs = texts.select("cid", "text").join(lists.select("cid"), "cid", "left_semi").mapInArrow(_signatures, "cid long, sign binary")
    columns = columns.join(stage(signs.join(lists, "cid"), "signatures"), "cid").repartition(blocks, "shingle")
    rest = stage(_possible(columns.mapInArrow(_across(percent), _PAIR), percent), "rest")
    return _grown(comps, _linked(rest, texts, percent))


def _grown(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (u, v)."""
    if comps is None:
        return stage(components(links), "components")
    if links.isEmpty():
        return comps
    stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stage(components(stars.unionByName(links)), "components")


def linked_documents(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row, and `class_size`: rows with the same set."""
    members, one = classes(docs, id_col, text_col)
    comps = class_components(one.select("cid", "text"), percent).select(F.col("node").alias("cid"), "component")
    placed = stage(
        one.select("cid", "least", "digest").join(comps, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "placed"
    )
    names = placed.groupBy("component").agg(F.min("least").alias("name"))
    named = placed.join(names, "component").select("digest", "name")
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("class_size"))
    named = named.join(sizes, "digest")
    return (
        members.join(named.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("n_shingles") > 0), "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
        )
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents with one of each component: that with the least id (then hash of its text). All columns stay.

    Documents without words stay. Rows that repeat an id and a text are one document and stay together.
    """
    linked = linked_documents(docs, percent)
    alone = linked.where("n_shingles = 0").select("doc_id", "text_hash")
    first = (
        linked.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_id")
        .agg(F.min("text_hash").alias("text_hash"))
        .select(F.col("component_id").alias("doc_id"), "text_hash")
    )
    stay = alone.unionByName(first).select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["stay_id"]) & (own == stay["stay_hash"]), "left_semi")
