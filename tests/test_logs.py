import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokentide.operators import fork, parse
from tokentide.plans import reports
from tokentide.plans.scan import LogScan
from tokentide.session import stage
from tokentide.sources import histories, logs

from conftest import at


def iso(t):
    return t.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def meta(ident, **more):
    return {"type": "session_meta", "timestamp": iso(at()), "payload": {"id": ident, **more}}


def tokens(t, total=None, last=None, limits=None, **info):
    counts = lambda n: {"input_tokens": n, "total_tokens": n}
    if total is not None:
        info["total_token_usage"] = counts(total)
    if last is not None:
        info["lastTokenUsage"] = {"inputTokens": last, "totalTokens": last}
    line = {"type": "event_msg", "payload": {"type": "token_count", "info": info}}
    if t is not None:
        line["timestamp"] = iso(t)
    if limits is not None:
        line["payload"]["rate_limits"] = limits
    return line


@pytest.fixture
def tree(tmp_path):
    """Writes log files below sessions/ (or archived_sessions/) and returns the session root."""

    def write(**files):
        for ident, lines in files.items():
            old = ident.startswith("old_")
            name = f"rollout-2026-05-10T00-00-00-{ident}.jsonl"
            folder = tmp_path / ("archived_sessions" if old else "sessions/2026/05/10")
            folder.mkdir(parents=True, exist_ok=True)
            text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
            (folder / name).write_text(text + "\n")
        return str(tmp_path / "sessions")

    return write


def test_counters_carry_and_skips(spark, tree):
    root = tree(
        one=[
            meta("s1", model="gpt-5.5", cwd="/a"),
            tokens(at(1), total=10),
            tokens(None, total=30),
            {"type": "turn_context", "payload": {"model": " ", "cwd": "/b", "collaborationMode": {"settings": {"effort": "high"}}}},
            tokens(at(2), total=45),
            tokens(at(3), last=7),
            tokens(at(3)),
            '{"type":"event_msg","payload":{"type":"token_count"}} trailing',
            tokens(at(4), total=45),
            tokens(at(999), total=50),
        ],
        old_two=[tokens(at(1), last=5)],
    )
    scan = LogScan(spark, root, at(-1), at(24))
    rows = scan.usage_records().orderBy("file_path", "line_no").collect()
    assert [(r.session_id, r.model, r.cwd, r.reasoning_effort, r.total_tokens) for r in rows] == [
        ("old_two", "unknown", "unknown", None, 5),
        ("s1", "gpt-5.5", "/a", None, 10),
        ("s1", "gpt-5.5", "/b", "high", 15),
        ("s1", "gpt-5.5", "/b", "high", 7),
    ]
    got = scan.usage_diagnostics().first().asDict()
    want = dict(read_files=2, read_lines=11, invalid_json_lines=1, token_count_events=8, included_usage_events=4,
                missing_metadata=1, missing_usage=1, empty_usage=1, out_of_range=1, fork_replay=0, fork_files=0)
    assert {k: got[k] for k in want} == want


def test_line_numbers_across_splits(spark, tree):
    root = tree(big=[json.dumps({"n": i, "pad": "x" * 50}) for i in range(5000)], small=["a", "", "b"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = logs.number_lines(logs.read_lines(spark, root))
        big = lines.where(F.col("value").contains('"n"'))
        assert big.select("block").distinct().count() > 5
        assert big.where(F.get_json_object("value", "$.n").cast("long") + 1 != F.col("line_no")).count() == 0
        rest = lines.where(~F.col("value").contains('"n"')).orderBy("line_no").collect()
        assert [(r.line_no, r.value) for r in rest] == [(1, "a"), (2, ""), (3, "b")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_forks(spark, tree):
    a = [meta("A", model="gpt-5.5"), tokens(at(1), total=20)]
    b = [meta("B"), *a, tokens(at(2), total=35)]
    c = [meta("C", model="other"), *b[0:1], *b[1:], tokens(at(3), total=42)]
    d = [meta("D"), *b, tokens(at(3), total=39)]
    orphan = [meta("E"), meta("gone"), tokens(at(4), total=1)]
    # Replayed lines get new timestamps.
    later = lambda lines: [lines[0]] + [{**x, "timestamp": iso(at(9))} for x in lines[1:-1]] + lines[-1:]
    root = tree(a=a, b=later(b), c=later(c), d=later(d), e=orphan)
    scan = LogScan(spark, root)
    found = {r.pinned_id: (r.parent_session_id, r.replay_prefix_lines) for r in scan.forks.collect()}
    assert found == {"B": ("A", 3), "C": ("B", 5), "D": ("B", 5), "E": ("gone", 0)}
    rows = {r.session_id: (r.total_tokens, r.model) for r in scan.usage_records().collect()}
    assert rows == {"A": (20, "gpt-5.5"), "B": (15, "unknown"), "C": (7, "other"), "D": (4, "unknown"), "E": (1, "unknown")}
    got = scan.usage_diagnostics().first()
    assert (got.fork_files, got.fork_parent_missing, got.fork_replay_lines, got.fork_replay) == (4, 1, 10, 5)


def test_stale_forks_are_not_counted(spark, tree):
    a = [meta("A"), tokens(at(1), total=20)]
    root = tree(a=a, b=[meta("B"), *a, tokens(at(2), total=30)], c=[meta("C"), tokens(at(50), total=5)])
    got = LogScan(spark, root, at(47), at(72)).usage_diagnostics().first()
    assert (got.fork_files, got.fork_parent_missing, got.fork_replay_lines) == (0, 0, 0)
    assert LogScan(spark, root).usage_diagnostics().first().fork_files == 1


def test_parent_by_name_outside_the_range(spark, tree, tmp_path):
    parent = [tokens(at(-2000), total=5), tokens(at(-1999), total=9)]
    root = tree(kid=[meta("kid"), meta("P-1"), tokens(at(1), total=12)])
    old = tmp_path / "sessions/2026/02/01"
    old.mkdir(parents=True)
    path = old / "rollout-2026-02-01T00-00-00-xP-1.jsonl"
    path.write_text("\n".join(map(json.dumps, [meta("P-1x")] + parent)))
    os.utime(path, (0, 0))
    scan = LogScan(spark, root, at(-1), at(24))
    assert scan.files.where("action = 'skip_old'").count() == 1
    got = scan.forks.first()
    assert got.parent_path.endswith("xP-1.jsonl") and got.replay_prefix_lines == 0


def test_fingerprint_ignores_time_and_key_order(spark):
    rows = ['{"a":1,"timestamp":2,"b":{"y":1,"x":[2,{"q":1,"p":2}]}}', '{"b":{"x":[2,{"p":2,"q":1}],"y":1},"a":1}', '{"a":1,"b":{"timestamp":1}}', '{"a":1}}', '{"a":2}}', "5", "[5]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(fork.fingerprint(F.col("v"))).collect()]
    assert got[0] == got[1] and got[3] == got[4] and len(set(got)) == 5


def numbered(spark, **files):
    rows = [(f, n, line if isinstance(line, str) else json.dumps(line)) for f, lines in files.items() for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "file_path string, line_no bigint, value string")


def test_replay_prefix_equals_line_by_line(spark):
    import random

    rng = random.Random(4)
    parent = [meta("p")] + [rng.choice([{"timestamp": iso(at(k)), "n": k % 7}, {"n": k, "timestamp": 1, "deep": {"timestamp": k}}, "broken %d" % (k % 3), "", "5"]) for k in range(60)]
    text = [x if isinstance(x, str) else json.dumps(x) for x in parent]
    again = lambda x: json.dumps({**x, "timestamp": iso(at(99))}) if isinstance(x, dict) and "deep" not in x else x if isinstance(x, str) else json.dumps(x)
    turned = lambda x: json.dumps(dict(reversed(list(x.items())))) if isinstance(x, dict) else x
    kids = {}
    for k, (cut, more) in enumerate([(0, 3), (1, 3), (5, 0), (7, 2), (8, 1), (9, 4), (30, 0), (61, 0), (61, 5), (40, 9)]):
        kids[f"a{k}"] = [meta("kid")] + [again(x) for x in parent[:cut]] + [json.dumps({"own": i}) for i in range(more)]
        kids[f"t{k}"] = [meta("kid")] + [turned(x) for x in parent[:cut]] + [json.dumps({"own": i}) for i in range(more)]
    kids["mixed"] = [meta("kid")] + [turned(x) if 10 < i < 20 else again(x) for i, x in enumerate(parent)] + ["end"]
    kids["empty"] = [meta("kid")]
    lines = numbered(spark, parent=parent, **kids)
    prints = {(r.file_path, r.line_no): r.fp for r in lines.withColumn("fp", fork.fingerprint(F.col("value"))).collect()}
    want = {}
    for kid, its in kids.items():
        n = 0
        while n + 1 < len(its) and prints.get(("parent", n + 1)) == prints[kid, n + 2]:
            n += 1
        want[kid] = n + 1 if n else 0
    found = spark.createDataFrame([(k, "parent") for k in kids] + [("none", None)], "file_path string, parent_path string")
    for block in (1, 8, 1000):
        got = {r.file_path: r.replay_prefix_lines for r in fork.replay_prefix(found, lines, block_lines=block).collect()}
        assert got == {**want, "none": 0}, block
    assert len(text) == 61 and want["mixed"] == 62


def test_lines_of_equal_blocks_are_not_parsed(spark, monkeypatch):
    plain = fork.fingerprint
    monkeypatch.setattr(fork, "fingerprint", lambda v: F.when(v.contains("poison"), F.raise_error(F.lit("parsed")).cast("string")).otherwise(plain(v)))
    parent = [{"timestamp": iso(at(k)), "type": "x", "payload": {"k": k, "v": "poison" if k < 8 else "tail"}} for k in range(12)]
    kid = [meta("kid")] + [{**x, "timestamp": iso(at(99))} for x in parent[:10]] + [{"own": 1}]
    found = spark.createDataFrame([("kid", "parent")], "file_path string, parent_path string")
    lines = numbered(spark, parent=parent, kid=kid)
    assert fork.replay_prefix(found, lines, block_lines=8).first().replay_prefix_lines == 11
    with pytest.raises(Exception, match="parsed"):
        fork.replay_prefix(found, lines, block_lines=16).first()


def test_parents_by_name(spark):
    names = ["rollout-a-%s.jsonl" % x for x in ("abcdefgh", "abcdefghij", "xabcdefghijk", "short", "Zz", "é\U0001f600ß-long-name", "abcd")] + ["other-abcdefghij.jsonl"]
    files = spark.createDataFrame([("/%02d/%s" % (9 - k, n), n) for k, n in enumerate(names)], "file_path string, file_name string")
    wanted = ["abcdefghij", "abcdefgh", "bcdefghijk", "shor", "z", "Z", "", "rollout-", "rollout-a-", "abcdefghix", "é\U0001f600ß-long-n", "n" * 300, ".jsonl", "none of them"]
    heads = spark.createDataFrame([("/k/%d" % k, "own%d" % k, w) for k, w in enumerate(wanted)], "file_path string, first_id string, second_id string")
    got = {r.parent_session_id: r.parent_path for r in fork.parents(heads, files).collect()}
    rows = [(r.file_path, r.file_name) for r in files.collect() if r.file_name.startswith("rollout-")]
    assert got == {w: min((p for p, n in rows if w and w in n), default=None) for w in wanted}


def test_pruning(spark, tmp_path):
    start, end = datetime(2026, 5, 10, tzinfo=UTC), datetime(2026, 5, 12, tzinfo=UTC)
    files = {
        "2026/05/10/rollout-2026-05-10T08-00-00-a.jsonl": "read",
        "2026/05/05/rollout-2026-05-05T08-00-00-b.jsonl": "tail",
        "2026/04/01/rollout-2026-04-01T08-00-00-c.jsonl": "tail_mtime",
        "2026/04/02/rollout-2026-04-02T08-00-00-d.jsonl": "skip_old",
        "2026/05/10/rollout-2026-05-13T08-00-00-e.jsonl": "skip_late",
        "2026/06/01/rollout-2026-05-10T08-00-00-f.jsonl": "skip_folder",
        "notes/2026/x.jsonl": "read",
    }
    for name in files:
        path = tmp_path / "sessions" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(tokens(start - timedelta(days=1) if "-b." in name else start, last=3)) + "\n")
        os.utime(path, (0, 0) if "-d." in name else None)
    root = str(tmp_path / "sessions")
    scan = LogScan(spark, root, start, end)
    # Folders after the range are not listed at all.
    assert {r.relative: r.action for r in scan.files.collect()} == {k: v for k, v in files.items() if v != "skip_folder"}
    assert sorted(r.session_id for r in scan.usage_records().collect())[:2] == ["a", "c"]
    got = scan.usage_diagnostics().first()
    assert (got.read_files, got.skipped_files, got.prefiltered_files, got.tail_read_files, got.mtime_read_files) == (3, 2, 1, 2, 2)
    assert (got.scanned_directories, got.skipped_directories) == (10, 1)
    full = LogScan(spark, root, start, end, full=True).files.where("action = 'tail'").count()
    assert full == 3
    assert LogScan(spark, str(tmp_path / "none"), start, end).usage_records().count() == 0


def test_listing_opens_only_what_a_range_needs(spark, tmp_path, monkeypatch):
    names = ["2025/12/31", "2026/01/01", "2026/01/02", "2026/02/01", "2026/13/01", "2027/01/01", "2027/02/01", "notes/2030", "9", "_tmp", "a[b]"]
    for name in names:
        (tmp_path / "sessions" / name).mkdir(parents=True)
        (tmp_path / "sessions" / name / "x.jsonl").write_text("{}\n")
    (tmp_path / "archived_sessions/2028/01/01").mkdir(parents=True)
    for flat in ("sessions/top.jsonl", "sessions/2026/01/month.jsonl", "archived_sessions/old.jsonl", "archived_sessions/2028/01/01/late.jsonl"):
        (tmp_path / flat).write_text("{}\n")
    opened = []
    real = logs._children
    monkeypatch.setattr(logs, "_children", lambda s, folder: opened.append(folder.split(tmp_path.name + "/")[1]) or real(s, folder))
    scan = logs.ScanRange(datetime(2026, 1, 1, tzinfo=UTC), datetime(2026, 1, 1, 12, tzinfo=UTC))
    listing = logs.plan_listing(spark, str(tmp_path / "sessions"), scan)
    # The later years and the later month stay closed; a day folder is opened by the reader, and only within the range.
    assert sorted(opened) == ["archived_sessions", "sessions", "sessions/2025", "sessions/2025/12", "sessions/2026", "sessions/2026/01", "sessions/2026/13"]
    assert (listing.opened, listing.skipped) == (7, 4)
    files = logs.list_logs(spark, str(tmp_path / "sessions"), scan, listing=listing).collect()
    assert sorted(r.relative for r in files) == [
        "2025/12/31/x.jsonl", "2026/01/01/x.jsonl", "2026/01/month.jsonl", "2026/13/01/x.jsonl", "9/x.jsonl", "a[b]/x.jsonl", "notes/2030/x.jsonl", "old.jsonl", "top.jsonl",
    ]
    assert logs.read_lines(spark, str(tmp_path / "sessions"), scan, listing=listing).count() == 9
    # Clocks west of Greenwich begin their days later.
    assert logs.plan_listing(spark, str(tmp_path / "sessions"), logs.ScanRange(scan.start, datetime(2026, 1, 2, 3, tzinfo=UTC)), "America/New_York").skipped == 4


def test_limit_lines(spark, tree):
    window = lambda m, u, r: {"window_minutes": m, "used_percent": u, "resets_at": r}
    reset = int(at(5).timestamp())
    root = tree(
        one=[
            meta(" s1 "),
            tokens(at(1), last=1, limits={"plan_type": " pro ", "limit_id": "l", "burst": window(15, 1, reset), "secondary": window("10080", "12.5", float(reset)), "primary": window(300, 125, str(reset)), "credits": 3}),
            tokens(at(1), last=1, limits=None) | {"payload": {"type": "token_count", "rate_limits": None}},
            tokens(at(1), last=1, limits={"primary": window(0, 1, reset), "secondary": window(5, "x", reset)}),
            tokens(at(1), last=1, limits={"primary": window(5, 1, 1.5), "secondary": 3}),
            tokens(None, last=1, limits={"primary": window(5, 1, reset)}),
            tokens(at(1), last=1, limits=[1]),
            '{"type": "event_msg", "rate_limits": 1}',
            '{"rate_limits" "session_meta"',
            tokens(at(99), last=1, limits={"primary": window(300, 1, reset)}),
        ]
    )
    scan = LogScan(spark, root, at(-1), at(24))
    rows = scan.quota_samples().orderBy("source_line", "window_minutes").collect()
    assert [(r.session_id, r.plan_type, r.window, r.used_percent, r.remaining_percent) for r in rows] == [
        ("s1", "pro", "burst", 1.0, 99.0), ("s1", "pro", "5h", 125.0, -25.0), ("s1", "pro", "7d", 12.5, 87.5)
    ]
    got = scan.sample_diagnostics().first().asDict()
    want = dict(invalid_json_lines=2, rate_limit_events=7, null_rate_limits=1, missing_rate_limits=1, missing_timestamps=1,
                missing_windows=3, unknown_windows=1, invalid_window_minutes=2, invalid_used_percent=1, invalid_resets_at=1,
                out_of_range_percent=1, included_samples=3, out_of_range_samples=1, rate_limit_only_files=0)
    assert {k: got[k] for k in want} == want
    record = scan.usage_records().where("line_no = 2").first()
    assert [x.window for x in record.rate_limits] == ["5h", "7d", "burst"]


def history(tmp_path, name, **doc):
    path = tmp_path / name
    path.write_text(json.dumps({"version": 1, "switches": [], **doc}))
    return str(path)


def test_histories(spark, tmp_path):
    switch = lambda h, a, b, source="auth select": dict(timestamp=iso(at(h)), fromAccountId=a, toAccountId=b, source=source)
    default = dict(accountId="a", observedAt=iso(at()), source="auth.json")
    path = history(tmp_path, "acc.json", defaultAccount=default, switches=[switch(5, "b", "c"), switch(1, "a", "b"), switch(7, "c", "x", "auth remove")])
    switches, first = histories.load_accounts(spark, path)
    assert first == "a" and [r.account_id for r in histories.ordered(switches).collect()] == ["b", "c", "x"]
    assert [r.account_id for r in histories.attribution(switches).orderBy("ts").collect()] == ["b", "c"]
    grown = histories.append_account(switches, "c", "d", at(9))
    assert grown.count() == 4
    assert histories.load_accounts(spark, str(tmp_path / "no.json")) is None
    assert histories.ensure_default(None, spark, "z")[1] == "z"
    with pytest.raises(ValueError):
        histories.load_accounts(spark, history(tmp_path, "v2.json", version=2))
    with pytest.raises(Exception, match="source"):
        histories.load_accounts(spark, history(tmp_path, "bad.json", switches=[switch(1, "a", "b", "who")]))[0].collect()

    mode = lambda h, fast, source: dict(timestamp=iso(at(h)), fast=fast, source=source)
    path = history(tmp_path, "mode.json", switches=[mode(3, False, "fast off"), mode(3, True, "fast on"), mode(1, False, "manual file edit")])
    modes, unset = histories.load_modes(spark, path)
    assert unset is None
    states = [histories.mode_status(modes, at(h)).first().state for h in (0, 2, 3)]
    assert states == ["unknown", "off", "on"]
    added = histories.append_mode(modes, False, at(3))
    assert histories.mode_status(added, at(4)).first().state == "off"
    with pytest.raises(Exception, match="source"):
        histories.load_modes(spark, history(tmp_path, "m.json", switches=[mode(1, True, "fast off")]))[0].collect()


def test_reports_end_to_end(spark, tree):
    limits = lambda used, reset: {"plan_type": "pro", "limit_id": "l", "secondary": {"window_minutes": 10080, "used_percent": used, "resets_at": int(reset.timestamp())}}
    root = tree(
        one=[meta("s1", model="gpt-5.5", cwd="/a"), tokens(at(1), last=100, limits=limits(10, at(days=7))), tokens(at(2), last=50, limits=limits(20, at(days=7)))],
        two=[meta("s2", model="odd", cwd="/b"), tokens(at(3), last=7, limits=limits(1, at(days=9)))],
    )
    src = reports.Sources(spark, root)
    start, end = at(-1), at(24)
    got = reports.usage_report(src, start, end, "cwd")
    assert [(r.key, r.total_tokens) for r in got["rows"].collect()] == [("/a", 150), ("/b", 7)]
    assert got["totals"].first().sessions == 2 and got["unpriced_models"].count() == 1
    assert [r.code for r in got["warnings"].collect()] == ["unpriced_calls"]
    assert [r.session_id for r in reports.sessions_report(src, start, end)["rows"].collect()] == ["s1", "s2"]
    one = reports.session_report(src, "s1", start, end)
    assert one["rows"].count() == 2 and one["summary"].first().total_tokens == 150 and one["compact"].count() == 2
    by_window = reports.window_usage_report(src, start, end)["rows"].collect()
    assert [r.total_tokens for r in by_window] == [150, 7]
    windows = reports.limit_report(src, "windows", start, end)
    # The last record comes before its own window starts, so it falls back to its only candidate.
    assert [(r.reset_kind, r.total_tokens) for r in windows["rows"].collect()] == [("firstObserved", 157), ("early", 0)]
    current = reports.limit_report(src, "current", start, end, now=at(24))
    assert [(r.status, r.total_tokens) for r in current["rows"].collect()] == [("active", 0)]
    for name in ("samples", "resets", "trend"):
        assert reports.limit_report(src, name, start, end)["status"].first().status == "ok"
    assert reports.detector_report(src, start, end)["rows"].count() == 0
    health = reports.health_report(src, at(24))
    assert (health["usage"].first().status, health["quota"].first().seven_day_samples) == ("warn", 3)


def test_prefilter_runs_before_parsing(spark):
    lines = spark.createDataFrame([("f", 0, 1, "junk"), ("f", 0, 2, 'junk "token_count"')], "file_path string, block bigint, line_no bigint, value string")
    assert [r.valid for r in parse.parse_lines(lines).collect()] == [False]


def test_names_by_a_filter_of_many_wanted_substrings(spark, monkeypatch):
    """Beyond a broadcast, names are told apart by a filter of bits before any is shuffled; parents stay the same."""
    files = spark.range(300).selectExpr("concat('/s/rollout-2026-05-10T00-00-00-user', id, '-x.jsonl') AS file_path").withColumn("file_name", F.substring("file_path", 4, 99))
    heads = spark.range(300).selectExpr(
        "concat('/k/', id) AS file_path", "concat('kid', id) AS first_id", "CASE WHEN id % 3 = 0 THEN concat('user', id, '-x') WHEN id % 3 = 1 THEN concat('r', id, '-') ELSE concat('other', id) END AS second_id"
    )
    few = {tuple(r) for r in fork.parents(heads, files).collect()}
    assert sum(r[-1] is not None for r in few) == 200
    monkeypatch.setattr(fork, "MAX_BROADCAST_ROWS", 10)
    monkeypatch.setattr(fork, "FILTER_BITS", 1 << 20)
    assert {tuple(r) for r in fork.parents(heads, files).collect()} == few
    grams = spark.createDataFrame([(f"gram{n:04}",) for n in range(50)], "gram string")
    named = spark.range(20_000).selectExpr("id", "concat('gram', lpad(id, 4, '0')) AS gram")
    got = fork._only_wanted(named, grams)
    assert got.where("id < 50").count() == 50 and got.count() < 100
    assert "LeftSemi" not in got._jdf.queryExecution().executedPlan().toString()


def test_files_are_judged_once_not_by_line(spark, tmp_path):
    """The plan that reads lines holds no test of file names, and skipped files are not among its inputs."""
    root = tmp_path / "sessions" / "2026" / "05"
    for day in ("09", "10"):
        (root / day).mkdir(parents=True)
        (root / day / f"rollout-2026-05-{day}T01-00-00-x [1] %20.jsonl").write_text("a\nb\n")
    (root / "10" / "rollout-2026-05-10T23-00-00-late.jsonl").write_text("late\n")
    scan = logs.ScanRange(datetime(2026, 5, 10, tzinfo=UTC), datetime(2026, 5, 10, 12, tzinfo=UTC))
    lines = logs.read_lines(spark, str(tmp_path / "sessions"), scan)
    assert lines.where("value = 'late'").isEmpty() and lines.count() == 4
    assert len(lines.inputFiles()) == 2 and "Filter" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert logs.read_lines(spark, str(tmp_path / "sessions")).count() == 5
    assert [r.line_no for r in logs.number_lines(lines).orderBy("file_path", "line_no").collect()] == [1, 2, 1, 2]


def test_leading_lines_are_parsed_once(spark):
    """What follows from a file's leading ids is stored; nothing that reads the parents parses the lines again."""
    meta = lambda i: '{"type":"session_meta","payload":{"id":"%s"}}' % i
    rows = [("/p", 1, meta("p")), ("/c", 1, meta("c")), ("/c", 2, meta("p"))]
    lines = stage(spark.createDataFrame(rows, "file_path string, line_no bigint, value string"), "forklines")
    found = fork.parents(fork.lineage(parse.parse_lines(lines)))
    assert [(r.file_path, r.parent_path) for r in found.collect()] == [("/c", "/p")]
    assert not any(lines.staged_at in f for f in found.inputFiles())
