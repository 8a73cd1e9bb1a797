import hashlib
import random

import numpy as np
import pytest

from tokentide.llm import repeats
from tokentide.llm.rindex import RunIndex


def pack(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


def longest(s, i, strings):
    best = 0
    while i + best < len(s) and any(s[i : i + best + 1] in t for t in strings):
        best += 1
    return best


def test_matching_statistics_against_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abc", bytes(range(256)), b"abcdefghij"])
        strings = [bytes(rng.choices(alphabet, k=rng.randint(1, rng.choice([5, 30, 90])))) for _ in range(rng.randint(1, 10))]
        strings += rng.choices(strings, k=rng.randint(0, 3))
        patterns = [bytes(rng.choices(alphabet + b"z", k=rng.randint(1, 40))) for _ in range(6)] + [s[len(s) // 2 :] for s in strings] + strings
        index = RunIndex(*pack(strings))
        for step, at, rows, length in index.stream(*pack(patterns)):
            for p, row, n in zip(at, rows, length, strict=True):
                s, i = patterns[p], len(patterns[p]) - 1 - step
                assert n == longest(s, i, strings)
                place = index.order[row]
                t = strings[index.string[place]]
                assert t[len(t) - index.left[place] :][:n] == s[i : i + n]


def test_runs_are_few_in_repetitive_text():
    rng = random.Random(1)
    text = bytes(rng.choices(b"abcdef", k=400))
    index = RunIndex(*pack([text] * 200))
    assert len(index.run_start) < index.rows / 50


def brute(rows, width=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - width + 1):
                w = t[k : k + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if i is not None and first[t[k : k + width]] < i:
                gone[k : k + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("full,block", [(4096, 1 << 20), (2, 1 << 12)])
def test_against_brute_force(docs, corpus, monkeypatch, full, block):
    monkeypatch.setattr(repeats, "FULL", full)
    monkeypatch.setattr(repeats, "INDEX_BYTES", block)
    want = brute(corpus)
    assert found(repeats.without_repeats(docs)) == want
    assert sum(0 < r[2] < r[1] for r in want) > 5 and any(r[3] > 1 for r in want)


@pytest.mark.parametrize("width", [12, 100])
def test_other_widths(docs, corpus, width):
    assert found(repeats.without_repeats(docs, width)) == brute(corpus, width)


def test_bytes_are_what_is_left(docs):
    for r in repeats.without_repeats(docs, with_bytes=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_edge_tables(spark, no_docs, null_rows):
    assert repeats.without_repeats(no_docs).collect() == []
    rows = [(r.doc_id, r.text) for r in null_rows.collect()] + [(9, "w " * 60), (None, "w " * 60), (9, "x" + "w " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.without_repeats(df)) == brute(rows)
