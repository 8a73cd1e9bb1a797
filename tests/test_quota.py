import random
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokentide.operators import chunked, quota, samples as S, trend

from conftest import at

DAY7 = timedelta(days=7)


def test_chunked_scans_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(f"k{min(rng.randrange(4), 1)}", i // 7, i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, chunk bigint, i bigint, v int")
    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "i",
        F.last("v", True).over(upto).alias("a"),
        F.last("v", True).over(before).alias("b"),
        F.lag("v").over(w).alias("p"),
        F.row_number().over(w).alias("rn"),
        F.sum(F.coalesce((~F.lag("v").over(w).eqNullSafe(F.col("v"))), F.lit(True)).cast("int")).over(w).alias("x"),
    )
    carried = chunked.carry_forward(df, ["k"], "chunk", ["i"], {"a": F.col("v")}, {"b": F.col("v")})
    linked = chunked.linked(df, ["k"], "chunk", ["i"], ["v"], lambda p, c: ~p["v"].eqNullSafe(c["v"]))
    got = carried.join(linked, "i").select("i", "a", "b", F.col("prev.v").alias("p"), "rn", F.col("run").alias("x"))
    run = Window.partitionBy("k").orderBy("i")
    flags = df.withColumn("s", F.when(F.row_number().over(run) == 1, 1).otherwise((~F.lag("v").over(run).eqNullSafe(F.col("v"))).cast("int")))
    plain = plain.drop("x").join(flags.select("i", F.sum("s").over(upto).alias("x")), "i")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select("i", "a", "b", "p", "rn", "x").collect()))


def test_jitter_joins_and_splits_windows(samples):
    reset = at() + DAY7
    rows = samples(
        (at(1), 1, reset + timedelta(seconds=1)), (at(2), 2, reset), (at(3), 3, reset + timedelta(seconds=30)),
        (at(4), 4, reset + timedelta(seconds=30, milliseconds=900)), (at(5), 5, reset + timedelta(hours=1)),
    )
    got = quota.order_windows(quota.quota_windows(rows)).collect()
    assert [(r.sample_count, r.reset_kind) for r in got] == [(4, "firstObserved"), (1, "changed")]
    assert got[0].reset_at.replace(tzinfo=None) == (reset + timedelta(seconds=30, milliseconds=900)).replace(tzinfo=None)
    assert got[0].id.startswith("7d-a-pro-l-reset-")


def test_resets_early_and_normal(samples):
    first, second = at() + DAY7, at() + 2 * DAY7
    rows = samples((at(1), 50, first), (at(2), 3, second), (at(days=15), 1, at(days=22)), (at(days=15, hours=1), 9, at(days=23)))
    got = quota.order_changes(quota.quota_resets(rows)).collect()
    assert [(r.kind, r.early_by_seconds) for r in got] == [("early", 7 * 86400 - 7200), ("normal", 0)]
    assert quota.quota_resets(rows, early_only=True).count() == 1


def test_inactive_stream_is_left_out(samples):
    idle = dict(limit_id="idle")
    rows = samples(
        *[(at(seconds=60 * i), 0, at(seconds=60 * i) + DAY7, idle) for i in range(3)], (at(1), 5, at(days=7)), (at(1), 5, at(days=7), {"session_id": "t"})
    )
    assert [r.limit_id for r in S.inactive_streams(rows).collect()] == ["idle"]
    assert quota.quota_windows(rows).count() == 1
    got = S.sample_counters(rows).first()
    assert (got.samples, got.duplicate_samples, got.ignored_inactive_stream_samples, got.status) == (5, 1, 3, "ok")


def test_current(samples):
    rows = samples((at(1), 4, at(days=7)), (at(2), 40, at(hours=5), {"window": "5h", "window_minutes": 300}), (at(days=9), 1, at(days=16)))
    got = quota.order_current(quota.quota_current(rows, at(hours=13))).collect()
    assert [(r.window, r.status, r.reset_in_seconds) for r in got] == [("5h", "expired", None), ("7d", "active", 7 * 86400 - 13 * 3600)]
    assert quota.current_status(quota.quota_current(rows, at(hours=13))).first().status == "ok"
    assert quota.current_status(quota.quota_current(rows, at(days=-1))).first().status == "unobserved"


def test_trend_golden(samples):
    reset, other = at(days=7), at(days=9)
    used = [(20, reset), (20, reset), (20, reset + timedelta(seconds=20)), (25, reset), (24, reset), (15, other), (15, other + timedelta(seconds=9)), (15, reset)]
    got = quota.order_changes(trend.quota_trend(samples(*[(at(hours=1 + i), u, r) for i, (u, r) in enumerate(used)]))).collect()
    assert [(r.kind, r.used_percent, r.delta_used_percent) for r in got] == [
        ("firstObserved", 20, None), ("increased", 25, 5), ("resetChanged", 15, -10), ("resetChanged", 15, 0)
    ]


def fold(rows):
    """The rule, one sample after the other."""
    state, out = None, []
    for ts, used, reset in rows:
        if state is None:
            kind = "firstObserved"
        elif abs((reset - state[1]) // timedelta(milliseconds=1)) >= 61_000:
            kind = "resetChanged"
        elif used - state[0] > 1e-6:
            kind = "increased"
        else:
            continue
        out.append((ts, kind, used))
        state = (used, reset)
    return out


def test_trend_equals_the_fold(samples):
    rng = random.Random(7)
    streams, rows = {}, []
    for s in range(6):
        reset, series = at(days=7), []
        for i in range(250):
            if s < 2:  # steady window with growing use
                reset = at(days=7 + (i // 60)) + timedelta(seconds=rng.choice([0, 20, 40]))
                used = min(100.0, (i % 60) + rng.choice([0, 0, 1, 3]) + (rng.random() * 1e-6 if s else 0))
            elif s < 4:  # resets that creep by less than twice the jitter
                reset = reset + timedelta(seconds=rng.choice([0, 13, 30, 55, 100, -70]))
                used = float(rng.randrange(5))
            else:  # resets that jump to and fro
                reset = at(days=rng.choice([7, 8])) + timedelta(seconds=rng.choice([0, 59, 65]))
                used = float(rng.randrange(30))
            series.append((at(seconds=97 * i), used, reset))
        streams[f"l{s}"] = series
        # A line number per sample and a source per row keep the compaction out of the comparison.
        rows += [(*x, {"limit_id": f"l{s}", "source_path": f"/p{s}-{i}", "source_line": 1}) for i, x in enumerate(series)]
    df = samples(*rows)
    for block in (10, 1000):
        got = trend.quota_trend(df, block_rows=block).collect()
        for name, series in streams.items():
            mine = sorted((r.at, r.kind, r.used_percent) for r in got if r.limit_id == name)
            assert mine == [(t.replace(tzinfo=None), k, u) for t, k, u in fold(series)], (name, block)


def test_trend_drops_what_a_source_repeats(samples):
    reset = at(days=7)
    row = lambda h, used, path: (at(h), used, reset + timedelta(hours=h if path == "b" else 0), {"source_path": path, "source_line": h})
    df = samples(row(1, 1, "a"), row(2, 1, "a"), row(3, 2, "a"))
    assert trend.compact_observations(trend.observations(df)).count() == 2
