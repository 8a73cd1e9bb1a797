import random
from bisect import bisect_right
from datetime import timedelta

from pyspark.sql import functions as F

from tokentide.operators import asof, chunked, detector, intervals as I, pricing, quota
from tokentide.session import stage

from conftest import at

MIN = timedelta(minutes=1)


def limit(minutes, reset, name="l", plan="pro"):
    return (plan, name, "x", minutes, reset)


def test_as_of_against_a_scan(spark, usage):
    rng = random.Random(3)
    times = [at(seconds=rng.randrange(40_000)) for _ in range(60)]
    switches = [(t, rng.choice("abc"), n) for n, t in enumerate(times + times[:20])]
    records = usage(*[(at(seconds=rng.randrange(-2000, 45_000)), n) for n in range(300)])
    df = spark.createDataFrame(switches, "ts timestamp, account_id string, pos bigint")
    got = asof.as_of(records, "timestamp", df, "account_id", "zero").select("timestamp", "account_id").collect()
    assert len(got) == 300
    ordered = sorted(switches, key=lambda s: (s[0], s[2]))
    for r in got:
        past = [s[1] for s in ordered if s[0].replace(tzinfo=None) <= r.timestamp]
        assert r.account_id == (past[-1] if past else "zero")
    assert asof.as_of(records, "timestamp", df.limit(0), "account_id").where("account_id IS NOT NULL").isEmpty()


def brute(records, windows):
    """The attachment rule by nested loops."""
    out = []
    for r in records:
        cand = [w for w in windows if w["start"] <= r["t"] < w["end"] and (w["account"] is None or w["account"] == r["account"])]
        exact = [
            w for w in cand
            if any(m == w["minutes"] and abs((x - w["end"]).total_seconds()) < 61 and n == w["limit"] for _, n, _, m, x in r["limits"])
        ]
        lone = [w for w in cand if sum((v["minutes"], v["account"]) == (w["minutes"], w["account"]) for v in cand) == 1]
        one = (max(exact, key=lambda w: (w["start"], w["end"], w["id"])) if exact else None) if r["limits"] else (cand[0] if len(cand) == 1 else None)
        out.append((r["n"], sorted(w["id"] for w in (exact or lone)), one and one["id"]))
    return out


def test_interval_joins_against_nested_loops(spark, usage, monkeypatch):
    rng = random.Random(5)
    windows, records = [], []
    for n in range(40):
        minutes = rng.choice([300, 10080])
        end = at(hours=rng.randrange(0, 400))
        windows.append(dict(id=f"w{n}", start=end - minutes * MIN, end=end, account=rng.choice([None, "a", "b"]), minutes=minutes, limit=rng.choice([None, "l", "m"])))
    for n in range(300):
        w = rng.choice(windows)
        named = [limit(w["minutes"], w["end"] + timedelta(seconds=rng.choice([-70, -60, 0, 45])), rng.choice([w["limit"], "zz"]))]
        named = named * rng.choice([0, 1, 2])
        t = w["start"] + timedelta(seconds=rng.randrange(-3600, w["minutes"] * 60 + 3600))
        records.append(dict(n=n + 1, t=t, account=rng.choice([None, "a", "b"]), limits=named))
    priced = pricing.price(usage(*[(r["t"], r["n"], {"account_id": r["account"], "rate_limits": r["limits"]}) for r in records]))
    df = spark.createDataFrame(
        [(w["id"], w["start"], w["end"], w["account"], "pro", w["limit"], w["minutes"], n) for n, w in enumerate(windows)],
        "id string, estimated_start timestamp, reset_at timestamp, account_id string, plan_type string, limit_id string, window_minutes bigint, island bigint",
    )
    wanted = brute(records, windows)
    for bound in (I.MAX_BROADCAST_ROWS, 0):  # broadcast, and the way beyond it
        monkeypatch.setattr(I, "MAX_BROADCAST_ROWS", bound)
        if not bound:
            monkeypatch.setattr(I, "broadcast_if_small", lambda d: d)
        numbered = I._number_windows(df)
        ids = {r.target_no: r.id for r in numbered.collect()}
        hits = {}
        for r in I.attach_matches(numbered, priced).collect():
            hits.setdefault(r.line_no, []).append(ids[r.target_no])
        single = {r.line_no: r.window_id for r in I.assign_windows(priced, numbered).collect()}
        assert [(n, sorted(hits.get(n, [])), single[n]) for n, _, _ in wanted] == wanted
    sums = I.attach_usage(df, priced).agg(F.sum("total_tokens")).first()[0]
    assert sums == sum(n * len(found) for n, found, _ in wanted)


def test_window_usage_rows(samples, usage):
    windows = stage(quota.quota_windows(samples((at(1), 5, at(days=7)))))
    priced = pricing.price(usage((at(2), 10), (at(3), 20), (at(days=8), 7)))
    got = I.usage_by_window(priced, windows, "7d").collect()
    assert [(r.observed, r.group_key == "unobserved", r.total_tokens) for r in got] == [(True, False, 30), (False, True, 7)]
    none = I.usage_by_window(priced.limit(0), windows.limit(0), "7d").collect()
    assert [(r.window_id, r.calls) for r in none] == [("unobserved:7d", 0)]
    zero = I.usage_by_window(priced.limit(0), windows, "7d").collect()
    assert [(r.observed, r.calls) for r in zero] == [(True, 0)]
    counts = I.unobserved_usage(priced, windows).first()
    assert (counts.observed_windows, counts.unobserved_usage_events) == (1, 1)


def five(ts, used, **more):
    return (ts, used, at(5), {"window": "5h", "window_minutes": 300, **more})


def test_detector_finds_the_costly_session(samples, usage):
    exact = {"rate_limits": [limit(300, at(5))]}
    calls, seen = [], [five(at(), 0)]
    # Two sessions of six calls and equal credits; the second takes 2.5 times the percent.
    used = 0.0
    for part, step in (("slow", 2.0), ("quick", 5.0)):
        for i in range(6):
            ts = at(seconds=60 * (len(calls) + 1))
            used += step / 2
            calls.append((ts, 100_000, {"session_id": part, "file_path": f"/{part}", **exact}))
            seen.append(five(ts, used))
    found = detector.Detection(samples(*seen), pricing.price(usage(*calls)))
    rows = found.candidates().collect()
    assert [(r.session_id, r.calls, r.sample_pairs, r.effective_multiplier, r.confidence) for r in rows] == [("quick", 6, 6, 2.5, "high")]
    assert {r.reason: r["count"] for r in found.reasons().collect()} == {"matchesExpectedFastMultiplier": 1, "normalMultiplier": 1}
    got = found.counters().first()
    assert (got.sample_pairs, got.exact_usage_matches, got.segments_with_usage, got.no_five_hour_samples) == (12, 12, 2, False)


def test_detector_without_samples(samples, usage):
    found = detector.Detection(samples((at(), 1, at(days=7))), pricing.price(usage((at(), 5))))
    assert [(r.reason, r["count"]) for r in found.reasons().collect()] == [("noFiveHourSamples", 1)]
    assert found.candidates().count() == 0


def test_confidence(spark):
    df = spark.createDataFrame([(2.0, 2.0), (1.6, 2.0), (2.8, 2.0), (1.2, 2.0)], "e double, x double")
    assert [r[0] for r in df.select(detector.confidence("e", "x")).collect()] == ["high", "medium", "low", "insufficient"]


def test_as_of_in_a_burst_of_switches(spark):
    """Thousands of switches in one minute: a record meets few intervals and still finds its own."""
    from tokentide.operators.asof import as_of

    n = 5000
    switches = spark.range(n).selectExpr("timestamp_micros(id * 10000) AS ts", "id AS pos", "cast(id AS string) AS v")
    late = spark.sql("SELECT timestamp_micros(864000000000) AS ts, 9999L AS pos, 'late' AS v")
    records = spark.range(n).selectExpr("id", "timestamp_micros(id * 10000 + 5) AS t")
    got = as_of(records, "t", switches.unionByName(late), "v")
    assert got.where("v = cast(id AS string)").count() == n and got.count() == n


def test_as_of_with_a_history_beyond_a_broadcast(spark, monkeypatch):
    """Blocks of neighbouring switches are broadcast, so no record is shuffled; beyond them records meet their block by its number."""
    rows = spark.range(400).select(F.timestamp_micros(F.col("id") * F.col("id") * 977).alias("ts"), (F.col("id") % 7).alias("v"), F.col("id").alias("pos"))
    switches = rows.withColumn("v", F.when(F.col("v") != 3, F.col("v")))
    records = spark.range(3000).select("id", F.when(F.col("id") % 97 != 0, F.timestamp_micros(F.col("id") * 60_000 - 500_000)).alias("t"))
    known = switches.orderBy("pos").collect()
    times = [r.ts for r in known]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound in (100, 20, 4):
            monkeypatch.setattr(asof, "MAX_BROADCAST_ROWS", bound)
            got = asof.as_of(records, "t", switches, "v", 9)
            found = got.collect()
            assert len(found) == 3000
            for r in found:
                before = bisect_right(times, r.t) if r.t else None
                assert r.v == (None if before is None else known[before - 1].v if before else 9)
            if bound == 100:
                assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sums_per_window_are_made_once(spark, usage, samples):
    """The test for an empty report and the report read stored sums, not the records again."""
    records = stage(pricing.price(usage((at(1), 10), (at(2), 20))), "records")
    windows = quota.quota_windows(samples((at(1), 1, at(5), dict(window="5h", window_minutes=300))))
    got = I.usage_by_window(records, windows, "5h")
    assert sum(r.total_tokens for r in got.collect()) == 30
    assert not any(records.staged_at in f for f in got.inputFiles())


def test_swept_against_a_scan(spark):
    rng = random.Random(5)
    rows = [(k, t // 50, t, rng.randrange(-3, 4), rng.randrange(9)) for k in "ab" for t in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "key string, chunk bigint, at bigint, d bigint, no bigint")
    got = {(r.key, r.at): (r.before, r.upto_d, r.upto_no) for r in chunked.swept(df, ["key"], "chunk", "at", ["d", "no"]).collect()}
    assert len(got) == len(rows)
    for k, _, t, *_ in rows:
        past = [r for r in rows if r[0] == k and r[2] <= t]
        before = max((r[2] for r in past if r[2] < t), default=None)
        assert got[k, t] == (before, sum(r[3] for r in past), sum(r[4] for r in past))


def test_spans_of_targets_meet_in_two_shuffles(spark, samples):
    """One pass over the stored turns, one row a chunk for the carried sums."""
    windows = quota.quota_windows(samples((at(1), 1, at(5)), (at(2), 1, at(30))))
    spans = I.coverage(I._window_targets(I._number_windows(windows)), [])
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 4 and all("/turns-" in f for f in spans.inputFiles())
