import random
import time
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pytest

from tokentide.operators import trend

from conftest import at
from test_quota import fold

JITTER, EPSILON = 61_000_000, 1e-6


def chain(used, reset, begin=0, state=None):
    """Accepted rows, one sample after the other."""
    out = []
    for k in range(begin, len(used)):
        if state is None or abs(int(reset[k]) - state[1]) >= JITTER or used[k] - state[0] > EPSILON:
            state = (used[k], int(reset[k]))
            out.append(k)
    return out


def shapes(rng, n):
    steps = rng.integers(-80_000_000, 100_000_000, n)
    return {
        "creeping": (rng.integers(0, 5, n).astype(float), np.cumsum(rng.integers(-40_000_000, 60_000_000, n))),
        "rolling": (np.zeros(n), np.arange(n) * 7_000_000),
        "all": (np.arange(n, dtype=float), np.zeros(n, np.int64)),
        "none": (np.zeros(n), np.zeros(n, np.int64)),
        "tiny growth": (np.arange(n) * 3e-8, rng.integers(0, 30_000_000, n)),
        "falling": (np.arange(n)[::-1].astype(float), np.cumsum(rng.integers(0, 9_000_000, n))),
        "not a number": (np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n)), np.cumsum(steps // 9)),
        "jumps": (rng.integers(0, 30, n).astype(float), rng.choice([0, 59_000_000, 65_000_000, 10**12], n)),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 700])
def test_next_accepted_row(n):
    rng = np.random.default_rng(n)
    for name, (used, reset) in shapes(rng, n).items():
        _, after = trend._next_accepted(used, reset)
        for k in range(n):
            found = [j for j in range(k + 1, n) if abs(int(reset[j]) - int(reset[k])) >= JITTER or used[j] - used[k] > EPSILON]
            assert after[k] == (found[0] if found else n), (name, k)


def table(used, reset, **more):
    n = len(used)
    key = {"account_id": pa.nulls(n, pa.string()), "plan_type": ["p"] * n, "limit_id": ["l"] * n, "window_minutes": [5] * n, "run": [1] * n, "block": [0] * n}
    return pa.table({**key, "rn": np.arange(n), "used_percent": used, "resets_us": reset, **more})


def test_blocks_compose():
    rng = np.random.default_rng(5)
    for name, (used, reset) in shapes(rng, 900).items():
        want = chain(used, reset)
        for size in (1, 7, 50, 900):
            got, state = [], None
            for b in range(0, 900, size):
                part = slice(b, b + size)
                n = len(used[part])
                before = pa.array([None if b == 0 else int(reset[b - 1])] * n, pa.int64())
                moves = trend._transfer(table(used[part], reset[part], before_reset=before)).to_pylist()
                given = {"state_used": pa.array([None if state is None else state[0]] * n, pa.float64()), "state_reset": pa.array([0 if state is None else state[1]] * n)}
                got += [b + x for x in trend._accept(table(used[part], reset[part], **given)).column("rn").to_pylist()]
                # The transfer rows alone lead to the same state.
                fits = [m for m in moves if state is None or abs(m["reset"] - state[1]) >= JITTER or m["used"] - state[0] > EPSILON]
                if fits:
                    state = (fits[0]["exit_used"], fits[0]["exit_reset"])
                assert state[1] == int(reset[got[-1]]) and (state[0] == used[got[-1]] or np.isnan(state[0])), (name, size, b)
            assert got == want, (name, size)


def test_time_grows_with_the_rows():
    def seconds(n):
        used, reset = np.arange(n, dtype=float), np.arange(n) * 100_000_000
        given = {"state_used": pa.nulls(n, pa.float64()), "state_reset": pa.nulls(n, pa.int64())}
        block = table(used, reset, **given)
        begun = time.process_time()
        assert len(trend._accept(block)) == n
        return time.process_time() - begun

    seconds(1000)
    assert seconds(500_000) < 15


def test_long_runs_of_blocks(samples):
    """Rolling and creeping resets through many blocks without a common row."""
    rng = random.Random(3)
    streams, rows = {}, []
    for s in range(3):
        series, reset = [], at(days=7)
        for i in range(200):
            reset = reset + timedelta(seconds=[30, rng.choice([1, 20, 59]), rng.choice([-50, 40])][s])
            series.append((at(seconds=30 * i), float(rng.randrange(3)), reset))
        streams[f"r{s}"] = series
        rows += [(*x, {"limit_id": f"r{s}", "account_id": None if s else "a", "source_path": f"/p{s}-{i}", "source_line": 1}) for i, x in enumerate(series)]
    df = samples(*rows)
    for block in (3, 64):
        got = trend.quota_trend(df, block_rows=block).collect()
        for name, series in streams.items():
            mine = sorted((r.at, r.kind, r.used_percent) for r in got if r.limit_id == name)
            assert mine == [(t.replace(tzinfo=None), k, u) for t, k, u in fold(series)], (name, block)
