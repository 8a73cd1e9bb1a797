import gzip
import hashlib
import os
import random

import pytest

from tokentide.llm import warc

SCHEMA = "page_id long, url string, html string, rid long, data string, chunk double"


def brute(rows, least=100):
    first = {}
    for k, (i, _, h) in enumerate(rows):
        first.setdefault((h or "").encode(), []).append((i is None, i or 0, k))
    out = []
    for k, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        of = min(first[b])
        again = len(b) >= least and of[2] != k
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", rows[of[2]][0] if again else None, True))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 0.5) for r in rows], SCHEMA).coalesce(1)


def by_text(rows):
    return sorted(map(repr, rows))


@pytest.fixture
def pages():
    rng = random.Random(2)
    long = "".join(rng.choices("abé\r\n<>ß€", k=3000))
    return [
        (1, "http://a/1", "<p>one</p>"),
        (2, "http://a/2", None),
        (3, None, ""),
        (4, "http://a/4", long),
        (5, "http://a/5", "x" * 99),
        (6, "http://a/6", "x" * 99),
        (7, "http://a/7", "y" * 100),
        (9, "http://a/8", "y" * 100),
        (8, "http://a/9", "y" * 100),
        (10, "http://a b\r\nX-Evil: 1/é", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9),
        (11, "", "\r\n\r\n\n\n\r"),
        (12, "http://a/12", long),
        (None, "http://a/n", long),
        (13, "http://a/13", "z" * 64),
        (14, "http://a/14", "z" * 128),
        (14, "http://a/14", "z" * 128),
    ] + [(20 + k, "http://copies/%d" % k, "copied " * 60) for k in range(60)]


@pytest.mark.parametrize("most", [7, 64, 1 << 16])
def test_round_trip(spark, pages, most):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    got = warc.round_trip(table(spark, pages), most=most).select(names).collect()
    assert by_text(tuple(r) for r in got) == by_text(brute(pages))


def test_archives_hold_standard_records(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    chunks = warc.chunk_table(table(spark, pages), most=1000)
    assert max(len(r.data) for r in chunks.collect()) <= 1000
    warc.write_archives(chunks, warc.revisits(chunks), path)
    raw = b"".join(gzip.open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    found = list(warc.parsed(iter([raw[k : k + 11] for k in range(0, len(raw), 11)]), 1 << 20))
    assert all(r["error"] is None for r in found)
    assert {r["record_type"] for r in found} == {"response", "revisit", "continuation"}
    # Payloads come back from the segments in order.
    segments = {}
    for r in found:
        segments.setdefault(r["origin"] or r["record_id"], []).append((r["segment"] or 1, r["data"], r["source_id"]))
    back = {p[0][2]: b"".join(x[1] for x in p) for p in map(sorted, segments.values()) if p[0][2]}
    assert back["4"] == pages[3][2].encode() and back["10"] == pages[9][2].encode()
    assert next(r["url"] for r in found if r["source_id"] == "10") == "http://a%20b%0D%0AX-Evil:%201/%C3%A9"


def test_other_archives(spark, tmp_path):
    def record(kind, body, extra="", length=None):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{len(body)}>\r\n{extra}Content-Length: {len(body) if length is None else length}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    binary = bytes(range(256)) * 40
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + binary
    good = [record("warcinfo", b"software: x\r\n"), record("resource", binary), record("response", http, "Content-Type: application/http\r\n")]
    broken = [record("metadata", b"q", length="many"), b"stray bytes\r\n", record("request", b"GET"), record("response", b"short", length=50)]
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(b"".join(good))
    with open(tmp_path / "b.warc", "wb") as f:
        f.write(b"".join(broken))
    got = warc.read_chunks(spark, str(tmp_path), most=100).collect()
    by_file = {}
    for r in sorted(got, key=lambda r: (r.path, r.offset, r.chunk)):
        by_file.setdefault((r.path[-6:], r.offset), []).append(r)
    a = [v for k, v in by_file.items() if k[0] == "arc.gz"]
    assert [b"".join(r.data for r in v) for v in a] == [b"software: x\r\n", binary, binary]
    assert [v[-1].sha256 for v in a[1:]] == [hashlib.sha256(binary).hexdigest()] * 2
    b = [v for k, v in by_file.items() if k[0] != "arc.gz"]
    assert [v[-1].error for v in b] == ["no length", "no record", None, "truncated"] or [v[-1].error for v in b] == ["no length", None, "truncated"]
    found = warc.records(warc.read_chunks(spark, str(tmp_path), most=100, with_data=False)).collect()
    assert len(found) == len(a) + len(b)


def test_missing_segment_is_reported(spark, pages, tmp_path):
    chunks = warc.chunk_table(table(spark, pages[3:4]), most=1000)
    none = warc.revisits(chunks)
    warc.write_archives(chunks.where("chunk <> 2"), none, str(tmp_path / "x"))
    (r,) = warc.records(warc.read_chunks(spark, str(tmp_path / "x"))).collect()
    assert r.error == "segment missing" and not r.intact


def test_digest_mismatch_is_seen(spark, tmp_path):
    os.makedirs(tmp_path / "y")
    with open(tmp_path / "y/a.warc", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (r,) = warc.records(warc.read_chunks(spark, str(tmp_path / "y"))).collect()
    assert r.intact is False and r.error is None


def test_edge_tables(spark):
    assert warc.round_trip(table(spark, [])).collect() == []
    got = warc.round_trip(table(spark, [(None, None, None), (None, None, None)])).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(None, 0, "response")] * 2
