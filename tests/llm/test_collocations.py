import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tokentide.llm import collocations
from tokentide.llm.automata import Counts

SCHEMA = "doc_id long, text string, lang string, rank double, phrase int, g string"


def brute(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for k in range(len(g) - m + 1):
                    part = g[k : k + m]
                    if 100 * a >= 80 * candidates[part]:
                        gone.add(part)
        scored = []
        for g, a in candidates.items():
            if g in gone:
                continue
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(k, *r, 1.0, 2, "x") for k, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["a", "A", "the", "of", "to", "b\x01", "b", "é", "ÉA", "x-y", "long" * 30, "\x00", "#", "ab", "a b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(120):
        parts = []
        for w in rng.choices(words, weights, k=rng.randint(0, 90)):
            parts += [w, rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ! ", "\x0b", "\x00 "])]
        rows.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    rows += [("one two three four five. " * 9, "en")] * 3 + [(None, "en"), ("", None), (" \t ", "en"), (".,;", "xx"), ("solo", "yy")]
    rows += [("the of " * 400, "en"), ("hot pair and tail%d " * 1 % 3 * 200, "de")]
    return rows


@pytest.mark.parametrize(("shard", "slice_", "ranges", "least", "most"), [(1 << 24, 1 << 21, 1 << 20, 3, 2000), (700, 64, 40, 5, 7), (1, 1, 1, 2, 50)])
def test_against_brute_force(spark, texts, shard, slice_, ranges, least, most):
    got = mined(spark, texts, least=least, most=most, shard_bytes=shard, slice_bytes=slice_, range_words=ranges)
    want = brute(texts, least, most)
    assert len(want) > 15
    assert got == want


def test_long_text(spark):
    rng = random.Random(8)
    text = " ".join(rng.choices(["in", "the", "end", "of", "all"], k=60_000))
    rows = [(text, "en"), (text.replace(" end", ". end"), "en")]
    assert mined(spark, rows, slice_bytes=1000, shard_bytes=5000, range_words=10_000) == brute(rows, 30, 2000)


def test_edge_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("a b", "en")]) == []


def test_union_sums_and_compose_looks_up():
    rng = np.random.default_rng(4)

    def made(n):
        p = rng.integers(1, 6, (n, 4)) * (10**12)
        cut = rng.integers(2, 5, n)
        p[np.arange(4) >= cut[:, None]] = 0
        return p[np.lexsort(p.T[::-1])]

    parts = [made(n) for n in (1, 50, 400)]
    want = Counter(tuple(r[:d]) for p in parts for r in p.tolist() for d in range(1, 5) if r[d - 1])
    whole = Counts.union([Counts.from_bytes(Counts.from_sorted(p, np.ones(len(p), np.int64)).to_bytes()) for p in parts])
    got = {}
    for d, level in enumerate(whole.levels, 1):
        got |= {tuple(r): w for r, w in zip(whole.paths(d).tolist(), level.weight.tolist(), strict=True)}
    assert got == want
    asked = Counts.from_sorted(made(300), np.ones(300, np.int64))
    for d, weights in enumerate(whole.compose(asked), 1):
        assert weights.tolist() == [want[tuple(r)] for r in asked.paths(d).tolist()]


def test_counts_past_32_bits():
    big = Counts.from_sorted(np.array([[3, 4, 0, 0]]), np.array([1 << 40]))
    twice = Counts.union([Counts.from_bytes(big.to_bytes())] * 2)
    assert [x.weight.tolist() for x in twice.levels] == [[1 << 41], [1 << 41], [], []]


def test_split_words_put_out_whole_frequent_phrases_only():
    rng = np.random.default_rng(5)
    parts = [np.where(rng.random(400) < 0.1, 0, rng.integers(1, 9, 400)).astype(np.int32) for _ in range(3)]
    local = np.arange(8)
    # Words 1 to 4 have ranges of their own with three splits each, the others share one.
    ids = np.where(local < 4, (local + 1) << 24, 9 << 24) + local + 1
    cells: dict[tuple, list] = {}
    for stream in parts:
        for batch in collocations._transducers(stream, local, ids, np.where(local < 4, 3, 1)):
            for row in batch.to_pylist():
                cells.setdefault((row["prefix"], row["split"]), []).append(row)
    found = [row for rows in cells.values() for row in collocations._united(3)(pa.Table.from_pylist(rows)).to_pylist()]
    wanted = Counter()
    for stream in parts:
        for size in (2, 3, 4):
            for k in range(len(stream) - size + 1):
                if (phrase := stream[k : k + size]).all():
                    wanted[tuple(ids[phrase - 1].tolist())] += 1
    assert sorted((tuple(r["g"]), r["a"]) for r in found) == sorted((g, a) for g, a in wanted.items() if a >= 3)
