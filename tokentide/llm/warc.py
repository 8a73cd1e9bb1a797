"""WARC archives as chunked record tables.

A payload travels as rows of (record, chunk number, bytes), each of at most `most` bytes, so no row, batch or buffer grows with a
record. Digests are carried along: whoever passes over the chunks of a record feeds them to one running SHA-256, and the last
chunk's row gets the sum. Payloads of more than one chunk are written as WARC segments (a first record and `continuation`
records), which may lie in any file; the reader brings the segments of a record together in order and carries the digest
through them.

Archives are written by Spark's text writer (records end with CR LF CR LF) and gzipped, so they may lie in any store that Spark
writes. The reader takes the lines of a file in order and parses them as a byte stream: a header block, then as many bytes as it
declares, so payloads may hold anything, also text that looks like a record. It also reads archives of other writers, with
records of any type and length, but a single line (bytes without a line feed) must fit a row.

Equal payloads are told by length and SHA-256. They meet as (digest, id) rows with a partial minimum; payloads themselves are
never grouped.

Defined cases: a null payload is empty; a null id is written without one, comes back as null and counts as the largest; rows that
repeat an id are records of their own (of equal payloads the earlier row is the response). White space, control characters and
non-ASCII bytes of a URL are percent-encoded. A record that ends early, lacks a length or misses segments comes back with `error`; the reader goes on at the next
line that begins a record. An empty table gives an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.session import broadcast_if_small, stage, staging_folder

CHUNK_BYTES = 1 << 16
LEAST_REVISIT = 100
# A header block, of a record or of the HTTP message in it, ends within so many bytes.
HEADER_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-record:"
_CHUNK = "rid long, id long, url string, payload_bytes long, chunks int, chunk int, data binary, payload_digest string"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `payload_digest` to the last chunk of each record; a record's chunks follow one another."""
    running = hashlib.sha256()
    for batch in batches:
        chunk, chunks = batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist()
        sums = []
        for k, data in enumerate(batch.column("data")):
            if chunk[k] == 0:
                running = hashlib.sha256()
            running.update(data.as_buffer())
            sums.append(running.hexdigest() if chunk[k] + 1 == chunks[k] else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "payload_digest"])


def chunk_table(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", most: int = CHUNK_BYTES
) -> DataFrame:
    """(rid, id, url, payload_bytes, chunks, chunk, data, payload_digest), staged: one row at least per row of `pages`."""
    plain = pages.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    sized = plain.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    sized = sized.withColumn("chunks", F.expr(f"cast(greatest(1L, (payload_bytes + {most - 1}) div {most}) as int)"))
    # The array is cut once per payload; the rows made of it don't hold the payload.
    parts = F.expr(f"transform(sequence(0, chunks - 1), k -> substring(payload, k * {most} + 1, {most}))")
    rows = sized.select("rid", "id", "url", "payload_bytes", "chunks", F.posexplode(parts).alias("chunk", "data"))
    return stage(rows.mapInArrow(_carried, _CHUNK), "chunks")


def revisits(chunks: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(rid, first): the records whose payload of at least `least` bytes equals that of `first`, which has the smallest id."""
    index = chunks.where("payload_digest IS NOT NULL").where(F.col("payload_bytes") >= least)
    index = index.select("rid", "id", "payload_bytes", "payload_digest")
    order = F.struct(F.col("id").isNull(), "id", "rid")
    firsts = index.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min_by("rid", order).alias("first"))
    # Written, so that the join's sides are plain shuffles and a group of a third of all rows can be split.
    firsts = stage(firsts.where("n > 1").drop("n"), "firsts")
    return stage(index.join(firsts, ["payload_digest", "payload_bytes"]).where("rid <> first").select("rid", "first"), "revisits")


def _line(name: str, value: Column) -> Column:
    """A header line, or null if the value is."""
    return F.concat(F.lit(f"{name}: "), value)


def _urn(rid: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), rid.cast("string"), F.lit(">"))


def _safe(url: Column) -> Column:
    """The URL with white space, control characters and what is not ASCII percent-encoded."""
    return F.when(url.rlike(r"[^\x21-\x7e]"), F.concat_ws("", F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)))).otherwise(url)


def write_archives(chunks: DataFrame, repeated: DataFrame, path: str, date: str = DATE) -> None:
    """Writes a record per chunk, and a revisit record in place of the chunks of each record in `repeated` (rid, first)."""
    repeated = broadcast_if_small(repeated)
    whole = chunks.where("payload_digest IS NOT NULL").join(repeated, "rid")
    whole = whole.select(*[c for c in chunks.columns if c != "data"], F.lit(b"").alias("data"), "first").withColumns(
        {"chunk": F.lit(0), "chunks": F.lit(1)}
    )
    rows = chunks.join(repeated, "rid", "left_anti").withColumn("first", F.lit(None).cast("long")).unionByName(whole)
    head = F.when(
        F.col("chunk") == 0,
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
            F.col("payload_bytes").cast("string"),
            F.lit("\r\n\r\n"),
        ),
    ).otherwise("")
    rows = rows.withColumn("http", head)
    length = F.octet_length("http") + F.octet_length("data")
    revisit, later = F.col("first").isNotNull(), F.col("chunk") > 0
    many, last = F.col("chunks") > 1, F.col("chunk") + 1 == F.col("chunks")
    number = (F.col("chunk") + 1).cast("string")
    # The HTTP header block of the first segment counts in the total.
    http_bytes = F.octet_length(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n"), F.col("payload_bytes").cast("string")))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.when(revisit, "revisit").when(later, "continuation").otherwise("response")),
        _line("WARC-Record-ID", F.when(later, F.concat(F.lit(f"<{_URN}"), F.col("rid").cast("string"), F.lit(":"), number, F.lit(">"))).otherwise(_urn(F.col("rid")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _safe(F.col("url"))),
        _line("X-Source-ID", F.when(~later, F.col("id").cast("string"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("WARC-Refers-To", _urn(F.col("first"))),
        _line("WARC-Segment-Number", F.when(many, number)),
        _line("WARC-Segment-Origin-ID", F.when(later, _urn(F.col("rid")))),
        _line("WARC-Segment-Total-Length", F.when(many & last, (http_bytes + F.col("payload_bytes")).cast("string"))),
        _line("Content-Type", F.when(~later, "application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    text = F.concat(header.cast("binary"), F.col("http").cast("binary"), F.col("data"))
    # The cast keeps the bytes as they are; the writer puts them out unchanged.
    rows.select(text.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Stream:
    """Bytes of one file, pulled as they are needed."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.offset = blocks, bytearray(), 0

    def pull(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held += block
        return True

    def until(self, mark: bytes, most: int) -> int:
        """Where `mark` begins within the next `most` bytes, or -1."""
        seen = 0
        while True:
            at = self.held.find(mark, seen, most)
            if at >= 0:
                return at
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) >= most or not self.pull():
                return -1

    def take(self, n: int) -> bytes:
        out = bytes(memoryview(self.held)[:n])
        del self.held[:n]
        self.offset += len(out)
        return out

    def at_least(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.pull():
                return False
        return True


def _fields(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def parsed(blocks: Iterator[bytes], most: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunks of the records of one file. Each record has a row with `last`; that row holds its digest or its error."""
    s = _Stream(blocks)
    while True:
        # White space between records; what else stands there is passed over as one broken record.
        while s.at_least(1) and s.held[0] in b"\r\n":
            s.take(len(s.held) - len(s.held.lstrip(b"\r\n")))
        if not s.at_least(1):
            return
        begin = s.offset
        s.at_least(5)
        end = s.until(b"\r\n\r\n", HEADER_BYTES) if s.held.startswith(b"WARC/") else -1
        fields = _fields(s.take(end + 4)[:-4]) if end >= 0 else {}
        length = fields.get("content-length", "")
        row = {
            "offset": begin,
            "record_id": fields.get("warc-record-id", "").strip("<>") or None,
            "record_type": fields.get("warc-type"),
            "url": fields.get("warc-target-uri"),
            "source_id": fields.get("x-source-id"),
            "declared": fields.get("warc-payload-digest"),
            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "segment": int(n) if (n := fields.get("warc-segment-number", "")).isdigit() and len(n) < 10 else None,
            "origin": fields.get("warc-segment-origin-id", "").strip("<>") or None,
            "error": None,
        }
        if not (length.isascii() and length.isdigit()):
            while (at := s.until(b"\nWARC/", 1 << 16)) < 0 and len(s.held) > 5:
                s.take(len(s.held) - 5)
            s.take(at + 1 if at >= 0 else len(s.held))
            yield row | {"chunk": 0, "last": True, "data": b"", "payload_bytes": 0, "sha256": None, "error": "no record" if end < 0 else "no length"}
            continue
        left = int(length)
        if fields.get("content-type", "").startswith("application/http") and row["origin"] is None:
            at = s.until(b"\r\n\r\n", min(left, HEADER_BYTES))
            if at >= 0:
                left -= len(s.take(at + 4))
        running, total, chunk = hashlib.sha256(), 0, 0
        while True:
            want = min(left, most)
            cut = not s.at_least(want)
            data = s.take(want)
            running.update(data)
            left -= len(data)
            total += len(data)
            last = cut or not left
            yield row | {
                "chunk": chunk, "last": last, "data": data, "payload_bytes": total,
                "sha256": running.hexdigest() if last else None, "error": "truncated" if cut else None,
            }
            if last:
                break
            chunk += 1


_READ = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
        ("source_id", pa.string()), ("declared", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()),
        ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("sha256", pa.string()), ("error", pa.string()),
    ]
)
_READ_SQL = (
    "path string, offset long, record_id string, record_type string, url string, source_id string, declared string, refers_to string, "
    "segment int, origin string, chunk int, last boolean, data binary, payload_bytes long, sha256 string, error string"
)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The files of a task one after another, each with its bytes in blocks."""
    runs = (
        (paths[k].as_py(), batch.column("line").slice(k, to - k))
        for batch in batches
        if len(batch)
        for paths in [batch.column("path")]
        for codes in [paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)]
        for edges in [[0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]]
        for k, to in zip(edges, edges[1:], strict=False)
    )
    held = next(runs, None)
    while held is not None:
        path, following = held[0], [held]

        def blocks(path: str = path, following: list = following) -> Iterator[bytes]:
            while following and following[0] is not None and following[0][0] == path:
                yield b"\n".join(following[0][1].to_pylist()) + b"\n"
                following[0] = next(runs, None)

        mine = blocks()
        yield path, mine
        for _ in mine:
            pass
        held = following[0]


def _read(most: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, blocks in _files(batches):
            for row in parsed(blocks, most):
                if not with_data and row["segment"] is None:
                    if not row["last"]:
                        continue
                    row["data"] = None
                rows.append(row | {"path": path})
                size += 500 + len(row["data"] or b"")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return run


def read_chunks(spark: SparkSession, path: str, most: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives under `path`. Without data, a record that is no segment has its last row only."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_read(most, with_data), _READ_SQL)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segmented record, from its chunks in order: bytes, digest, and what is wrong."""
    key, running, total, last_segment, wrong, declared = None, hashlib.sha256(), 0, 0, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((key, pa.string()), (total, pa.int64()), (running.hexdigest(), pa.string()), (declared, pa.string()), (wrong, pa.string()))],
            names=["key", "payload_bytes", "sha256", "declared", "error"],
        )

    for batch in batches:
        part = {c: batch.column(c).to_pylist() for c in ("key", "segment", "chunk", "declared", "error")}
        for k, data in enumerate(batch.column("data")):
            if part["key"][k] != key:
                if key is not None:
                    yield row()
                key, running, total, last_segment, wrong, declared = part["key"][k], hashlib.sha256(), 0, 0, None, None
            if part["chunk"][k] == 0:
                if part["segment"][k] != last_segment + 1:
                    wrong = "segment missing"
                last_segment = part["segment"][k]
            wrong = wrong or part["error"][k]
            declared = declared or part["declared"][k]
            running.update(data.as_buffer())
            total += len(data.as_buffer())
    if key is not None:
        yield row()


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: (record_id, record_type, url, source_id, refers_to, payload_bytes, payload_digest, intact, error).

    `intact`: the digest that the archive declares is that of the bytes read; null for revisits and where none is declared.
    """
    names = ["record_id", "record_type", "url", "source_id", "refers_to", "declared", "payload_bytes", "sha256", "error"]
    plain = chunks.where("segment IS NULL AND last").select(names)
    parts = chunks.where("segment IS NOT NULL").withColumn("key", F.coalesce("origin", "record_id", F.concat_ws(":", "path", "offset")))
    ordered = parts.select("key", "segment", "chunk", "declared", "error", "data").repartition("key").sortWithinPartitions("key", "segment", "chunk")
    sums = ordered.mapInArrow(_joined, "key string, payload_bytes long, sha256 string, declared string, error string")
    heads = parts.where("chunk = 0 AND segment = 1").select("key", "record_id", "record_type", "url", "source_id", "refers_to")
    whole = sums.join(heads, "key", "left").withColumn("error", F.coalesce("error", F.when(F.col("record_id").isNull(), "segment missing")))
    found = plain.unionByName(whole.withColumn("record_id", F.coalesce("record_id", "key")).select(names))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    return found.select(
        "record_id",
        "record_type",
        "url",
        "source_id",
        "refers_to",
        F.when(~revisit, F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared", "^sha256:", "")).otherwise(F.col("sha256")).alias("payload_digest"),
        F.when(~revisit & F.col("declared").startswith("sha256:"), F.col("declared") == F.concat(F.lit("sha256:"), F.col("sha256"))).alias("intact"),
        "error",
    )


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact): revisits get the length and id of the record they name."""
    found = stage(found, "records")
    first = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("of_bytes"), F.col("source_id").alias("of_id"),
        F.col("payload_digest").alias("of_digest"), F.col("intact").alias("of_intact"),
    )
    plain = found.where("record_type IS NULL OR record_type <> 'revisit'").select(
        F.col("source_id").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"), "intact",
    )
    again = found.where("record_type = 'revisit'").join(first, "refers_to", "left").select(
        F.col("source_id").cast("long").alias("page_id"), "url", F.col("of_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("of_id").cast("long").alias("refers_to"), (F.col("of_intact") & (F.col("payload_digest") == F.col("of_digest"))).alias("intact"),
    )
    return plain.unionByName(again)


def round_trip(pages: DataFrame, most: int = CHUNK_BYTES, least: int = LEAST_REVISIT, path: str | None = None) -> DataFrame:
    """Writes the archives of `pages` under `path` (else beside the staged tables), reads them back and resolves revisits."""
    spark = pages.sparkSession
    path = path or f"{staging_folder(spark)}/warc-{uuid.uuid4().hex}"
    chunks = chunk_table(pages, most=most)
    write_archives(chunks, revisits(chunks, least), path)
    return resolved(records(read_chunks(spark, path, most, with_data=False)))
