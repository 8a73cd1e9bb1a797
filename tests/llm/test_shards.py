import hashlib
import zlib

from tokentide.llm import shards


def brute(corpus, n=16, share=0.01):
    rows = [(hashlib.md5((t or "").encode()).hexdigest(), i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus]
    total = sum(r[2] for r in rows)
    group = {}
    for k, _, s, _ in rows:
        group[k] = group.get(k, 0) + s
    rows.sort(key=lambda r: (r[0], -(1 << 63) if r[1] is None else r[1]))
    out, at, begin, slots, last = {}, 0, 0, {}, None
    for k, i, s, c in rows:
        if k != last or group[k] > share * total / n:
            begin = at
        last = k
        shard = min(n - 1, begin * n // total)
        slots[shard] = slots.get(shard, -1) + 1
        out[i] = (s, c, "bytes", shard, slots[shard], None)
        at += s
    return out


def found(df):
    return {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in df.collect()}


def test_against_brute_force(docs, corpus):
    assert found(shards.shards(docs)) == brute(corpus)


def test_hot_group_is_divided(spark):
    rows = [(i, "copied text " * 5 if i % 3 == 0 else "text %d " % i * (1 + i % 7)) for i in range(3000)]
    got = found(shards.shards(spark.createDataFrame(rows, "doc_id long, text string"), 8))
    assert got == brute(rows, 8)
    sums = [sum(v[0] for v in got.values() if v[3] == s) for s in range(8)]
    assert max(sums) - min(sums) < 0.03 * sum(sums) / 8 + 200


def test_one_record_outweighs_the_rest(spark):
    rows = [(i, "x" * (100_000 if i == 5 else 3) + str(i)) for i in range(50)]
    assert found(shards.shards(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == brute(rows, 4)


def test_edge_tables(no_docs, null_rows):
    assert shards.shards(no_docs).collect() == []
    got = shards.shards(null_rows, 4).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
