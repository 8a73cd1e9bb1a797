import json
import os
from datetime import UTC, datetime, timedelta

import pytest

from tokentide.plans.scan import LogScan
from tokentide.sources import logs, manifest

from test_logs import meta, tokens

START, END = datetime(2026, 5, 10, tzinfo=UTC), datetime(2026, 5, 12, tzinfo=UTC)


@pytest.fixture
def tree(tmp_path):
    """Files in the range, before it with and without events in it, and forks."""
    hour = lambda h: START + timedelta(hours=h)
    reset = int(hour(200).timestamp())
    quota = {"plan_type": "pro", "limit_id": "l", "primary": {"window_minutes": 300, "used_percent": 3, "resets_at": reset}}
    a = [meta("A", model="m1"), *[tokens(hour(h), total=10 * h + 10) for h in range(4)]]
    files = {
        "2026/05/10/rollout-2026-05-10T00-00-00-a.jsonl": a,
        "2026/05/10/rollout-2026-05-10T05-00-00-b.jsonl": [meta("B"), *a, tokens(hour(5), total=90, limits=quota)],
        "2026/05/05/rollout-2026-05-05T08-00-00-old.jsonl": [tokens(hour(-40), last=3, limits=quota), "junk", ""],
        "2026/05/05/rollout-2026-05-05T09-00-00-long.jsonl": [tokens(hour(-40), last=4), {"x": 1}, tokens(hour(3), last=5)],
        "2026/05/06/rollout-2026-05-06T09-00-00-quota.jsonl": [tokens(hour(-40), last=4), {"type": "event_msg", "timestamp": "2026-05-10T01:00:00.000Z", "payload": {"type": "token_count", "rate_limits": quota}}],
        "2026/05/06/rollout-2026-05-06T10-00-00-silent.jsonl": ["nothing here", ""],
        "2026/05/07/rollout-2026-05-07T10-00-00-empty.jsonl": [],
        "2026/06/01/rollout-2026-06-01T10-00-00-late.jsonl": [tokens(hour(3), last=5)],
    }
    for name, its in files.items():
        path = tmp_path / "sessions" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in its))
    return tmp_path


def everything(scan):
    records = [tuple(r) for r in scan.usage_records().select("file_path", "line_no", "session_id", "model", "total_tokens").collect()]
    samples = [tuple(r) for r in scan.quota_samples().select("source_path", "source_line", "used_percent").collect()]
    forks = [tuple(r) for r in scan.forks.select("pinned_id", "parent_session_id", "replay_prefix_lines").collect()]
    return sorted(records), sorted(samples), sorted(forks), scan.usage_diagnostics().first().asDict(), scan.sample_diagnostics().first().asDict()


def test_reports_share_an_index(spark, tree, monkeypatch):
    root, path = str(tree / "sessions"), str(tree / "index")
    opened, counted = [], []
    read, splits = logs.read_files, logs.splits
    monkeypatch.setattr(logs, "read_files", lambda s, paths: opened.extend(p.rsplit("-", 1)[1][:-6] for p in paths) or read(s, paths))
    monkeypatch.setattr(logs, "splits", lambda lines: counted.append(1) or splits(lines))
    plain = everything(LogScan(spark, root, START, END))
    assert len(plain[0]) == 6 and len(plain[1]) == 2 and plain[3]["prefiltered_files"] == 1 and plain[4]["prefiltered_files"] == 1
    first = LogScan(spark, root, START, END, manifest=path)
    assert everything(first) == plain
    assert manifest.load(spark, path).count() == 6
    opened.clear(), counted.clear()
    again = LogScan(spark, root, START, END, manifest=path)
    again.events, again.stale, again._lines_read(again.stale).collect()
    # Known to end before the range: not opened. Known lines: not counted.
    assert sorted(opened) == ["a", "b", "long", "quota", "silent"] and not counted
    assert everything(again) == plain
    assert manifest.load(spark, path).count() == 6

    # A file that has grown is read in full, once.
    grown = tree / "sessions/2026/05/05/rollout-2026-05-05T08-00-00-old.jsonl"
    with open(grown, "a") as f:
        f.write(json.dumps(tokens(START + timedelta(hours=7), last=70)) + "\n")
    counted.clear()
    later = LogScan(spark, root, START, END, manifest=path)
    later.events  # noqa: B018
    assert len(counted) == 1
    assert [r.total_tokens for r in later.usage_records().where("file_path LIKE '%-old.jsonl'").collect()] == [70]
    assert later.usage_records().count() == 7 and later.usage_diagnostics().first().prefiltered_files == 0


def test_splits_cut_anew(spark, tmp_path):
    big = tmp_path / "sessions/2026/05/10/rollout-2026-05-10T00-00-00-big.jsonl"
    big.parent.mkdir(parents=True)
    rows = [json.dumps(tokens(START + timedelta(seconds=i), last=i + 1)) if i % 7 == 3 else "x" * 90 for i in range(900)]
    big.write_text("\n".join(rows) + "\n")
    root, path = str(tmp_path / "sessions"), str(tmp_path / "index")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = []
        for size in (20_000, 20_000, 30_000, 8_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            scan = LogScan(spark, root, START, END, manifest=path)
            got.append(sorted((r.line_no, r.total_tokens) for r in scan.usage_records().collect()))
        assert got == [[(i + 1, i + 1) for i in range(900) if i % 7 == 3]] * 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_tree(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    scan = LogScan(spark, str(tmp_path / "sessions"), START, END, manifest=str(tmp_path / "index"))
    assert scan.usage_records().count() == 0 and scan.quota_samples().count() == 0
    assert os.listdir(tmp_path / "sessions") == []
