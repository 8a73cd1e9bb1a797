from datetime import UTC, datetime, timedelta

import pytest

from tokentide.functions import ranges as R
from tokentide.sources.logs import ScanRange

NOW = datetime(2026, 5, 17, 12, tzinfo=UTC)


def test_durations():
    assert R.parse_duration("12h") == timedelta(hours=12)
    assert R.parse_duration("7d") == timedelta(days=7)
    assert R.parse_duration("2w") == timedelta(days=14)
    assert R.parse_duration("1mo") == timedelta(days=30)
    for bad in ("0d", "3m", "", "d", "-1d", "99999999999999999999mo"):
        with pytest.raises(ValueError):
            R.parse_duration(bad)


def test_bounds():
    assert R.parse_bound("2026-05-10") == datetime(2026, 5, 10, tzinfo=UTC)
    assert R.parse_bound("2026-05-10", end=True) == datetime(2026, 5, 10, 23, 59, 59, 999000, tzinfo=UTC)
    assert R.parse_bound("2026-05-10T10:00:00+02:00") == datetime(2026, 5, 10, 8, tzinfo=UTC)
    assert R.parse_bound("2026-05-10 10:00", tz="Europe/Berlin") == datetime(2026, 5, 10, 8, tzinfo=UTC)
    # The hour that occurs twice: the earlier one. The hour that never occurs: an error.
    assert R.parse_bound("2026-10-25 02:30", tz="Europe/Berlin") == datetime(2026, 10, 25, 0, 30, tzinfo=UTC)
    with pytest.raises(ValueError):
        R.parse_bound("2026-03-29 02:30", tz="Europe/Berlin")
    for bad in ("2026-13-01", "yesterday", "2026-05-10T25:00"):
        with pytest.raises(ValueError):
            R.parse_bound(bad)


def test_ranges_and_groups():
    assert R.resolve_range(NOW).start == NOW - timedelta(days=7)
    assert R.resolve_range(NOW, today=True).start == datetime(2026, 5, 17, tzinfo=UTC)
    assert R.resolve_range(NOW, yesterday=True).end == datetime(2026, 5, 16, 23, 59, 59, 999000, tzinfo=UTC)
    assert R.resolve_range(NOW, month=True).start == datetime(2026, 5, 1, tzinfo=UTC)
    assert R.resolve_range(NOW, all=True).start.year == 1900
    assert R.resolve_limit_range(NOW).start == NOW - timedelta(days=30)
    assert R.resolve_limit_range(NOW, "current").start == NOW - timedelta(days=7)
    for bad in (dict(today=True, month=True), dict(today=True, start="2026-05-01"), dict(century=True)):
        with pytest.raises(ValueError):
            R.resolve_range(NOW, **bad)
    group = lambda days: R.resolve_group(R.DateRange(NOW - timedelta(days=days), NOW))
    assert [group(d) for d in (2, 31, 100, 300)] == ["hour", "day", "week", "month"]
    assert R.resolve_group(R.resolve_range(NOW, all=True), all=True) == "month"
    assert R.resolve_group(R.resolve_range(NOW), "cwd") == "cwd"
    with pytest.raises(ValueError):
        R.resolve_group(R.resolve_range(NOW), "minute")


def test_lookback_is_clamped():
    scan = lambda days: ScanRange(NOW - timedelta(days=days), NOW)
    assert [(s.start - s.lookback_start).days for s in (scan(1), scan(40), scan(400))] == [7, 20, 30]
