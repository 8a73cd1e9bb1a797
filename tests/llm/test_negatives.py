import math
import random

import numpy as np
import pytest

from tokentide.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, key double, score long"


def brute(rows, every=50):
    part = []
    for r, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((r, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for r, i, label, v in part:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m, s) for s, j, m, w in part)
        same = [(-s, j) for s, j, m, q in scored if m == label and q != r][:5]
        for ps, p in same:
            fits = [(-s, j) for s, j, m, _ in scored if m != label and 50 * ps <= 100 * -s <= 95 * ps][:3]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def collected(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 64, 130), (100, 33, 71), (1, 64, 300)])
def test_product_is_exact(shape):
    rng = np.random.default_rng(3)
    n, k, m = shape
    a, b = rng.integers(-(2**26), 2**26, (n, k)), rng.integers(-(2**26), 2**26, (k, m))
    want = [[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T] for row in a]
    for leaf in (1, 4, 16):
        assert (negatives.product(a, b, leaf) == np.array(want)).all()


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    # A label of a third of all rows, repeated vectors and ids, ties, zero vectors, odd lengths, nulls.
    rows = []
    for i in range(420):
        v = [rng.gauss(0.1, 0.2) for _ in range(6)]
        rows.append((i, v, 1 if i % 3 == 0 else rng.randint(0, 9)))
    rows += [(k, list(rows[7][1]), k % 4) for k in range(420, 460)]
    rows += [(50, list(rows[3][1]), 1), (50, list(rows[3][1]), 1), (100, [0.0] * 6, 2), (461, [0.0] * 6, 3)]
    rows += [(500, [0.3, 0.1], 1), (501, [0.2] * 9, 4), (502, [], 4), (550, [], 4)]
    rows += [(None, [0.1] * 6, 1), (503, None, 1), (504, [0.1] * 6, None), (505, [None, 0.1], 1), (506, [float("nan")], 1), (600, [float("inf")], 2)]
    rows += [(-50, [0.5] * 6, 1), (-7, [0.5] * 6, -3)]
    want = brute(rows)
    assert len(want) > 50
    assert collected(spark, rows) == want
    monkeypatch.setattr(negatives, "TILE_ROWS", 4)
    monkeypatch.setattr(negatives, "MOST_BROADCAST", 2)
    assert collected(spark, rows) == want


def test_ties_and_windows(spark):
    v = [0.5, 0.5]
    rows = [(50, v, 1)] + [(k, v, 1) for k in (9, 3, 5, 1, 2, 4)] + [(k, [0.25, 0.5], 2) for k in (30, 20, 10, 40)] + [(60, v, 2)]
    got = collected(spark, rows)
    assert got == brute(rows)
    assert [r[3] for r in got if r[1] == 1] == [10, 20, 30]


def test_edge_tables(spark):
    assert collected(spark, []) == []
    assert collected(spark, [(1, [0.5], 1)]) == []
    assert collected(spark, [(50, [0.5], 1)]) == []
    with pytest.raises(ArithmeticError):
        collected(spark, [(50, [1e30], 1), (1, [1e30], 1)])
