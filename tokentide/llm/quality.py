"""Quality rules by cross-document line frequency.

Each document's lines are normalised (A-Z lower-cased, white space folded) and hashed. A line that
stands in more distinct documents of one host than the limit allows is boilerplate: it is removed from all of them but
the one with the smallest id, and a document that is left with too little is rejected.

Defined cases: a null text is an empty one; a null host is a host of its own, equal to the empty name; rows with the same
id and text count as one document for frequencies and get equal verdicts; an empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.llm.words import SPACE, Words, covered, mix, pieces, repeated, span_hash
from tokentide.session import stage

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A line is boilerplate above this many documents of its host and this share of them.
LINE_DOCS = 10
LINE_SHARE = 0.05
# A document is depleted with fewer words left than MIN_WORDS or than this share of its words.
LEAST_LEFT = 0.2

_OUT = (
    "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<no: int, hash: long, words: int>>"
)
_LINE = pa.struct([("no", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            yield _measured(piece)


def _measured(piece: pa.RecordBatch) -> pa.RecordBatch:
    column = piece.column("text")
    w = Words(column)
    docs = len(column)
    letters = w.solid & ((w.data & 0xC0) != 0x80)
    salt = mix(np.arange(docs, dtype=np.uint64))
    raw = w.hashes()
    h, at = w.windows(raw, REPEAT_WIDTH)
    again = repeated(mix(h ^ salt[w.doc[at]]))
    repeats = w.per_row_words(covered(len(raw), at[again], REPEAT_WIDTH))

    # Lines end at a line feed or at the text's end.
    feeds = np.flatnonzero(w.data == 10)
    ends = np.sort(np.concatenate([feeds, w.offset[1:]]))
    starts = np.sort(np.concatenate([feeds + 1, w.offset[:-1]]))
    line_doc = np.repeat(np.arange(docs), 1 + np.searchsorted(feeds, w.offset[1:]) - np.searchsorted(feeds, w.offset[:-1]))
    line_no = np.arange(len(ends)) - np.searchsorted(line_doc, line_doc)
    a, b = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
    full = np.flatnonzero(b > a)
    starts, ends, line_doc, line_no, a, b = (x[full] for x in (starts, ends, line_doc, line_no, a, b))
    plain = mix(span_hash(w.values, starts, ends) ^ salt[line_doc])
    n_lines = np.bincount(line_doc, minlength=docs)
    _, firsts = np.unique(plain, return_index=True)
    n_distinct = np.bincount(line_doc[firsts], minlength=docs)

    lowered = Words(column, lower=True).hashes()
    normal = span_hash(lowered, a, b).view(np.int64)
    lines = pa.StructArray.from_arrays(
        [pa.array(line_no.astype(np.int32)), pa.array(normal), pa.array((b - a).astype(np.int32))], fields=list(_LINE)
    )
    at_line = np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            piece.column("doc_id"),
            piece.column("host"),
            piece.column("text_hash"),
            pa.array(w.count.astype(np.int64)),
            pa.array(w.per_row(letters)),
            pa.array(w.per_row(SYMBOLS[w.data] & ~SPACE[w.data])),
            pa.array((n_lines - n_distinct).astype(np.int64)),
            pa.array(repeats),
            pa.ListArray.from_arrays(pa.array(at_line), lines),
        ],
        names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its base counts and its lines as (number, hash of the normal form, words)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(_measure, _OUT)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def frequent_lines(
    measured: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE
) -> DataFrame:
    """Lines above the limit: (host, hash, n_docs, keeper), the keeper being the smallest id with the line."""
    hosts = measured.select("host", "doc_id", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    once = measured.select("host", "doc_id", "text_hash", F.explode("lines.hash").alias("hash")).distinct()
    counted = once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
    return (
        counted.where(F.col("n_docs") > line_docs)
        .join(hosts, "host")
        .where(F.col("n_docs") > line_share * F.col("host_docs"))
        .select("host", "hash", "n_docs", "keeper")
    )


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """Base counts and the verdict per row, with the numbers of the lines to remove (`removed_lines`)."""
    measured = stage(measures(docs, id_col, text_col, host_col), "lines")
    frequent = frequent_lines(measured, line_docs, line_share)
    removed = (
        measured.select("doc_id", "text_hash", "host", F.explode("lines").alias("line"))
        .select("doc_id", "text_hash", "host", F.col("line.no").alias("no"), F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
        .join(frequent, ["host", "hash"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("host", "doc_id", "text_hash", "no", "words")
        .agg(F.count(F.lit(1)))
        .groupBy("host", "doc_id", "text_hash")
        .agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("no")).alias("removed_lines"))
    ).select(
        F.col("host").alias("r_host"), F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "removed_words", "removed_lines"
    )
    out = measured.drop("lines").join(
        removed,
        F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("host") == F.col("r_host")),
        "left",
    )
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < least_left * F.col("n_words")))
    return out.select(
        "doc_id",
        "host",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(depleted, F.lit(False))).alias("kept"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their boilerplate lines; `n_chars` follows the text, all other columns stay."""
    verdict = (
        verdicts(docs)
        .where("kept")
        .select(F.col("doc_id").alias("v_id"), F.col("text_hash").alias("v_hash"), F.col("host").alias("v_host"), "removed_lines")
        .distinct()
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
        F.coalesce("source", F.lit("")).alias("host"),
    )
    joined = keyed.join(
        verdict,
        F.col("id").eqNullSafe(F.col("v_id")) & (F.col("hash") == F.col("v_hash")) & (F.col("host") == F.col("v_host")),
    )
    left = F.filter(F.split("row.text", "\n", -1), lambda _, no: ~F.array_contains("removed_lines", no))
    text = F.when(F.size("removed_lines") > 0, F.array_join(left, "\n")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
