import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tokentide.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    count = Counter()
    for i, t, *_ in rows:
        if not held_out(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held_out(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    assert all(math.isfinite(r.score) for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


@pytest.mark.parametrize("most", [250_000, 40])
def test_counts_against_brute_force(docs, corpus, monkeypatch, most):
    real = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts, ends: real(counts, ends, classes=20, most=most))
    assert found(lm.scores(docs)) == brute(corpus)


def test_scores_are_normalised(spark):
    counts = spark.createDataFrame([(k * 7919 + 1, n) for k, n in enumerate([50, 30, 9, 4, 2, 1, 1])], "hash long, n long")
    v = lm.vocabulary(counts, 6, classes=5)
    model = lm.Model(lm._log_share(v))
    one, two = np.array([0, 3, 4]), np.array([1, 3, 0])
    total = np.exp(model.hidden(one, two) @ model.q.T + model.b - model.normalisers(one, two)[:, None]).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-5)
    rest = [n for n, k in zip(v.counts, v.classes, strict=True) if k == v.rest]
    assert math.isclose(sum((n + 0.1) / v.rest_total for n in rest) + 0.1 / v.rest_total, 1)


def test_batched_scores_equal_one_by_one():
    hashes = np.sort(np.random.default_rng(0).integers(0, 2**63, 3, dtype=np.uint64))
    v = lm.Vocabulary(hashes, np.array([5, 4, 3]), np.array([0, 1, 2], np.int32), np.array([5, 4, 3, 2, 0]), 14, 4, 2)
    s = lm.Sequence(pa.array(["a b", None, "", "c"]), v)
    assert s.doc.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert s.kind.tolist() == [4, 4, 3, 3, 3, 4, 3]
    assert s.one.tolist() == [3, 4, 4, 3, 3, 3, 4] and s.two.tolist() == [3, 3, 4, 3, 3, 3, 3]


def test_context_helps_on_held_out_text(spark):
    rng = random.Random(6)
    vocabularies = [[f"{c}{k}" for k in range(40)] for c in "xyz"]
    rows = [(k, " ".join(rng.choices(rng.choice(vocabularies), k=120))) for k in range(600)]
    out = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), rate=1.0).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens + 0.15


def test_defaults_train_on_every_position(spark):
    rng = random.Random(6)
    vocabularies = [[f"{c}{k}" for k in range(40)] for c in "xyz"]
    rows = [(k, " ".join(rng.choices(rng.choice(vocabularies), k=120))) for k in range(600)]
    out = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens + 0.15


def test_words_with_vectors_grow_and_stay_normalised(spark):
    counts = spark.createDataFrame([(k * 7919 + 1, 4000 - k) for k in range(3900)] + [(-k, 9) for k in range(1, 50)], "hash long, n long")
    v = lm.vocabulary(counts, 6)
    assert len(set(v.classes.tolist()) - {v.rest}) == 3900
    model = lm._model(v, None)
    model.q += np.random.default_rng(3).normal(0, 0.5, model.q.shape).astype(np.float32)
    s = lm.Sequence(pa.array(["x"]), v)
    kinds = np.array([k for k in range(len(model.b)) if not v.end - v.groups <= k < v.end])
    s.kind, s.one, s.two = kinds, np.full(len(kinds), len(model.b) - 1), np.full(len(kinds), 5)
    assert math.isclose(np.exp(lm._log_probability(s, v, model)).sum(), 1, abs_tol=1e-4)


def test_context_helps_beyond_the_most_frequent_words(spark):
    rng = random.Random(6)
    vocabularies = [[f"{c}{k}" for k in range(300)] for c in "uvwxyz"]
    rows = [(k, " ".join(rng.choices(rng.choice(vocabularies), k=150))) for k in range(1500)]
    out = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens + 0.15


def test_what_tasks_send_keeps_in_proportion(spark, monkeypatch):
    rng = random.Random(8)
    known = [f"w{k}" for k in range(1000)]
    rows = spark.createDataFrame([(k, " ".join(rng.choices(known, k=150))) for k in range(700)], "doc_id long, text string").repartition(40)
    tasks, real = [], type(rows).mapInArrow

    def counted(df, run, schema, *a, **b):
        if schema == lm._SUMS:
            tasks.append(df.rdd.getNumPartitions())
        return real(df, run, schema, *a, **b)

    monkeypatch.setattr(type(rows), "mapInArrow", counted)
    out = lm.scores(rows)
    assert len(tasks) == 2 * lm.TURNS and max(tasks[::2]) * 746 * lm.SEEN <= 1.2 * out.first().train_tokens
    assert lm._tasks(lm.Vocabulary(*[np.zeros(0)] * 4, 10**6, 0, 0, np.zeros(1000)), 16) == 48


def test_steps_equal_plain_adagrad():
    rng = np.random.default_rng(4)
    model = lm.Model(np.log(np.full(50, 0.02)))
    r, q, b, c = (x.astype(float) for x in (model.r, model.q, model.b, model.c))
    sums = [np.full(x.shape, lm.FIRST_SUM) for x in (r, q, b, c)]
    training = lm.Training(model)
    for _ in range(3):
        one, two, target, noise = (rng.integers(0, 50, k) for k in (90, 90, 90, lm.NOISE))
        training.step(one, two, target, noise)
        h = c[0] * r[one] + c[1] * r[two]
        less = np.log(0.02) + np.log(lm.NOISE)
        up = 1 / (1 + np.exp((h * q[target]).sum(axis=1) + b[target] - less)) / 90
        down = -1 / (1 + np.exp(-(h @ q[noise].T + b[noise] - less))) / 90
        gh = up[:, None] * q[target] + down @ q[noise]
        grads = [np.zeros_like(x) for x in (r, q, b, c)]
        np.add.at(grads[0], one, gh * c[0])
        np.add.at(grads[0], two, gh * c[1])
        np.add.at(grads[1], target, up[:, None] * h)
        np.add.at(grads[1], noise, down.T @ h)
        np.add.at(grads[2], target, up)
        np.add.at(grads[2], noise, down.sum(axis=0))
        grads[3][...] = [(gh * r[one]).sum(axis=0), (gh * r[two]).sum(axis=0)]
        for x, s, g in zip((r, q, b, c), sums, grads, strict=True):
            s += g * g
            x += lm.STEP * g / np.sqrt(s)
    found = training.vectors(np.arange(50)).astype(float)
    assert np.allclose(found, np.concatenate([r, q, b[:, None] - np.log(0.02)], axis=1), atol=2e-3)
    assert np.allclose(training.c, c, atol=1e-4)


@pytest.mark.parametrize("scale", [0.5, 40])
def test_normalisers_of_any_size(scale):
    model = lm.Model(np.log(np.full(600, 1 / 600)))
    model.q += np.random.default_rng(5).normal(0, scale, model.q.shape).astype(np.float32)
    one, two = np.arange(600), np.arange(600)[::-1]
    for members in (None, slice(100, 350)):
        s = model.hidden(one, two).astype(float) @ model.q[members or slice(None)].T + model.b[members or slice(None)]
        want = s.max(axis=1) + np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))
        assert np.allclose(model.normalisers(one, two, members), want, rtol=1e-5, atol=1e-4)
        target = np.arange(600) % 250 + 100
        own = s[np.arange(600), target - (members.start if members else 0)]
        assert np.allclose(model.normalisers(one, two, members, target), want - own, rtol=1e-5, atol=2e-3)


def test_words_are_found_among_crowded_hashes():
    rng = np.random.default_rng(9)
    for known in (rng.integers(0, 2**63, 1000, dtype=np.uint64), np.arange(300, dtype=np.uint64) + np.uint64(2**63), np.array([5], np.uint64)):
        known = np.unique(known)
        v = lm.Vocabulary(known, known, known, np.zeros(2), 0, 0, 0)
        asked = np.concatenate([known, known + np.uint64(1), rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)])
        at, there = v.find(asked)
        assert (there == np.isin(asked, known)).all() and (known[at[there]] == asked[there]).all()


def test_edge_tables(spark, no_docs, null_rows):
    assert lm.scores(no_docs).collect() == []
    assert found(lm.scores(null_rows)) == brute([(r.doc_id, r.text) for r in null_rows.collect()])
    only = spark.createDataFrame([(i, "a b") for i in range(200) if held_out(i)], "doc_id long, text string")
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in lm.scores(only).collect())
