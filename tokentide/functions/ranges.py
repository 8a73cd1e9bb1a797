"""Report ranges and granularity, resolved on the driver into literals."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from tokentide.operators.usage import GROUPS, one_of

MS = timedelta(milliseconds=1)
DAY = timedelta(days=1)
MAX_MS = 2**63 - 1
HOURS = {"h": 1, "d": 24, "w": 7 * 24, "mo": 30 * 24}
LOCAL_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M")
QUICK = ("all", "today", "yesterday", "month", "last")


@dataclass(frozen=True)
class DateRange:
    start: datetime
    end: datetime


def _exists(wall: datetime, zone: ZoneInfo) -> bool:
    back = wall.replace(tzinfo=zone).astimezone(UTC).astimezone(zone)
    return back.replace(tzinfo=None, fold=0) == wall.replace(fold=0)


def local_to_utc(wall: datetime, tz: str = "UTC", now: datetime | None = None) -> datetime:
    """Wall time to UTC: the earlier of two, and with today's offset when there is none."""
    zone = ZoneInfo(tz)
    if _exists(wall, zone):
        return wall.replace(tzinfo=zone, fold=0).astimezone(UTC)
    offset = (now or datetime.now(UTC)).astimezone(zone).utcoffset()
    return (wall - offset).replace(tzinfo=UTC)


def parse_bound(text: str, end: bool = False, tz: str = "UTC") -> datetime:
    """A day (its first or last millisecond), an RFC 3339 time, or a local time."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            day = datetime.strptime(text, "%Y-%m-%d")
        except ValueError:
            raise ValueError(f"invalid {'end' if end else 'start'} time: {text}") from None
        return local_to_utc(day + DAY - MS if end else day, tz)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", text):
        return datetime.fromisoformat(text.upper()).astimezone(UTC)
    for pattern in LOCAL_FORMATS:
        try:
            wall = datetime.strptime(text, pattern)
        except ValueError:
            continue
        if not _exists(wall, ZoneInfo(tz)):
            raise ValueError(f"invalid local time: {text}")
        return local_to_utc(wall, tz)
    raise ValueError(f"invalid {'end' if end else 'start'} time: {text}")


def parse_duration(text: str) -> timedelta:
    """`12h`, `7d`, `2w` or `1mo` (30 days)."""
    match = re.fullmatch(r"\s*([0-9]+)(h|d|w|mo)\s*", text)
    if not match:
        raise ValueError("use a duration like 12h, 7d, 2w, or 1mo")
    amount = int(match[1])
    if amount <= 0:
        raise ValueError("duration must be a positive integer")
    millis = amount * HOURS[match[2]] * 3_600_000
    if millis > MAX_MS:
        raise ValueError("duration is too large")
    try:
        return timedelta(milliseconds=millis)
    except OverflowError:
        raise ValueError("duration is too large") from None


def resolve_range(
    now: datetime,
    start: str | None = None,
    end: str | None = None,
    tz: str = "UTC",
    default_days: int = 7,
    **quick,
) -> DateRange:
    """One quick option (all, today, yesterday, month, last='7d') or start/end; else the last days."""
    unknown = set(quick) - set(QUICK)
    if unknown:
        raise ValueError(f"unknown range option: {', '.join(sorted(unknown))}")
    used = [name for name in QUICK if quick.get(name)]
    if len(used) > 1:
        raise ValueError("use only one quick range option")
    if used and (start or end):
        raise ValueError("quick range options cannot be combined with start or end")
    midnight = now.astimezone(ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    today = local_to_utc(midnight, tz, now)
    if used == ["all"]:
        # The far end stays in UTC, where it cannot overflow.
        far = datetime(9999, 12, 31, 23, 59, 59, 999000, tzinfo=UTC)
        return DateRange(local_to_utc(datetime(1900, 1, 1), tz, now), far)
    if used == ["today"]:
        return DateRange(today, now)
    if used == ["yesterday"]:
        return DateRange(today - DAY, today - MS)
    if used == ["month"]:
        return DateRange(local_to_utc(midnight.replace(day=1), tz, now), now)
    if used == ["last"]:
        try:
            return DateRange(now - parse_duration(quick["last"]), now)
        except OverflowError:
            raise ValueError("duration is too large") from None
    last = parse_bound(end, True, tz) if end else now
    first = parse_bound(start, False, tz) if start else last - default_days * DAY
    return DateRange(first, last)


def resolve_limit_range(now: datetime, report: str = "windows", **options) -> DateRange:
    """Quota reports: `current` always looks at the last 7 days, the others at 30 by default."""
    if report == "current":
        return DateRange(now - 7 * DAY, now)
    return resolve_range(now, default_days=30, **options)


def add_months(moment: datetime, months: int, tz: str = "UTC") -> datetime:
    """The same local day and time some months on, or the month's last day."""
    local = moment.astimezone(ZoneInfo(tz)).replace(tzinfo=None)
    year, month = divmod(local.year * 12 + local.month - 1 + months, 12)
    day = min(local.day, calendar.monthrange(year, month + 1)[1])
    return local_to_utc(local.replace(year=year, month=month + 1, day=day), tz)


def resolve_group(span: DateRange, group: str | None = None, tz: str = "UTC", **quick) -> str:
    """The asked-for grouping, or one that suits the range."""
    if group is not None:
        return one_of(group, GROUPS, "group")
    if quick.get("all"):
        return "month"
    if quick.get("month"):
        return "day"
    length = span.end - span.start
    if length <= timedelta(hours=48):
        return "hour"
    if length <= 31 * DAY:
        return "day"
    return "week" if span.end <= add_months(span.start, 6, tz) else "month"
