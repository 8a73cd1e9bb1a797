"""Whole reports: a log folder and options in, result frames out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import detector, diagnostics, health, ingest, intervals, pricing, quota, samples, sessions, trend, usage
from tokentide.plans.scan import LogScan
from tokentide.session import stage
from tokentide.sources.ratecard import RateCard, built_in


@dataclass
class Sources:
    """Where a report reads from; histories are (switches, default) pairs or None."""

    spark: SparkSession
    sessions_dir: str
    accounts: tuple | None = None
    modes: tuple | None = None
    card: RateCard | None = None
    tz: str = "UTC"
    full_scan: bool = False

    def scan(self, start=None, end=None, full: bool | None = None) -> LogScan:
        return LogScan(self.spark, self.sessions_dir, start, end, self.full_scan if full is None else full, self.tz)

    def rates(self) -> RateCard:
        return self.card or built_in(self.spark)

    def priced(self, scan: LogScan, account_id: str | None = None, modes: bool = True) -> DataFrame:
        records = scan.usage_records(self.accounts, self.modes if modes else None, account_id)
        return stage(pricing.price(records, self.rates()), "priced")


def usage_report(src: Sources, start, end, group: str, effort=False, sort=None, limit=None, account_id=None) -> dict[str, DataFrame]:
    """Rows, totals, unpriced models, fast attribution, counters and warnings."""
    scan = src.scan(start, end)
    priced = src.priced(scan, account_id)
    rate = src.rates().credits_per_usd
    unpriced = pricing.unpriced_models(priced)
    calls = unpriced.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("unpriced_calls"))
    counters = stage(
        diagnostics.side_by_side(
            scan.usage_diagnostics(src.accounts, src.modes, account_id), usage.fast_attribution(priced), calls
        ),
        "counters",
    )
    return {
        "rows": usage.usage_by(priced, group, effort, src.tz, sort, limit, rate),
        "totals": usage.usage_totals(priced, group, effort, src.tz, rate),
        "unpriced_models": unpriced,
        "diagnostics": counters,
        "warnings": diagnostics.warnings(counters, src.full_scan, unpriced),
    }


def sessions_report(src: Sources, start, end, sort=None, top=None, limit=None, account_id=None) -> dict[str, DataFrame]:
    priced = src.priced(src.scan(start, end), account_id)
    rate = src.rates().credits_per_usd
    return {
        "rows": sessions.sessions_top(priced, sort, sessions.top_n(top, limit), rate),
        "totals": sessions.sessions_totals(priced, rate),
        "unpriced_models": pricing.unpriced_models(priced),
    }


def session_report(src: Sources, session_id: str, start, end, limit=None, account_id=None) -> dict[str, DataFrame]:
    """Drill-down of one session; always reads every file that may hold it."""
    priced = src.priced(src.scan(start, end, full=True), account_id).where(F.col("session_id") == session_id)
    rate = src.rates().credits_per_usd
    events = sessions.session_events(priced, None, rate)
    return {
        "summary": sessions.session_rows(priced, rate),
        "rows": sessions.order_events(events, limit),
        "compact": sessions.session_compact(events, tz=src.tz, credits_per_usd=rate),
        "by_model": sessions.session_breakdown(events, "model", rate),
        "by_cwd": sessions.session_breakdown(events, "cwd", rate),
        "by_effort": sessions.session_breakdown(events, "effort", rate),
        "switches": sessions.session_switches(events),
        "totals": sessions.sessions_totals(priced, rate),
    }


def window_usage_report(src: Sources, start, end, selector="7d", group="window", effort=False, sort=None, limit=None, account_id=None) -> dict[str, DataFrame]:
    """Usage per quota window. Samples are read one window length before the range, so a
    window that began earlier is still seen."""
    minutes = intervals.SELECTORS[selector]
    early = start - timedelta(minutes=minutes)
    seen = src.scan(early, end).quota_samples(src.accounts, account_id=account_id, window_minutes=minutes)
    windows = stage(intervals.overlapping(quota.quota_windows(seen), start, end), "windows")
    priced = src.priced(src.scan(start, end), account_id)
    rate = src.rates().credits_per_usd
    counts = intervals.unobserved_usage(priced, windows)
    return {
        "rows": intervals.usage_by_window(priced, windows, selector, group, effort, sort, limit, src.tz, rate),
        "totals": sessions.sessions_totals(priced, rate),
        "diagnostics": counts,
        "warnings": diagnostics.warnings(counts),
    }


def limit_report(src: Sources, report: str, start, end, now: datetime | None = None, early_only=False, evidence=False, **filters) -> dict[str, DataFrame]:
    """Quota reports: samples, windows, resets, trend or current. Windows and current rows carry their usage.

    Where a sample came from (path and line) is shown with `evidence` only.
    """
    scan = src.scan(start, end)
    minutes = filters.get("window_minutes")
    found = stage(scan.quota_samples(src.accounts, **filters), "samples")
    counters = samples.sample_counters(found)
    if report == "samples":
        rows = samples.order_samples(found)
        return {"rows": rows if evidence else ingest.without_evidence(rows), "status": quota.row_status(found), "counters": counters}
    if report == "resets":
        rows = quota.order_changes(quota.quota_resets(found, early_only))
        # The status tells whether any live sample was seen.
        seen = samples.active_samples(found)
        return {"rows": rows, "status": quota.row_status(seen), "counters": counters, "unknown": quota.unknown_limit_resets(rows)}
    if report == "trend":
        rows = stage(trend.quota_trend(found, minutes), "trend")
        return {"rows": quota.order_changes(rows), "status": quota.row_status(rows), "counters": counters}
    rate = src.rates().credits_per_usd
    if report == "windows":
        windows = stage(quota.quota_windows(found), "windows")
    elif report == "current":
        current = quota.quota_current(found, now).withColumn("island", F.lit(0).cast("long"))
        windows = stage(current.withColumn("reset_at", F.col("resets_at")), "current")
    else:
        raise ValueError(f"unknown quota report: {report!r}")
    span = intervals.usage_range(windows).first()
    if span["start"] is not None:
        usage_scan = src.scan(_utc(span["start"]), _utc(span["end"]))
        windows = intervals.attach_usage(windows, src.priced(usage_scan, filters.get("account_id")), rate)
    else:
        zero = {"total_tokens": F.lit(0).cast("long"), "credits": F.lit(0.0), "usd": F.lit(0.0)}
        windows = windows.withColumns(zero)
    rows = windows.drop("island")
    if report == "current":
        rows = rows.drop("reset_at", "estimated_start")
        return {"rows": quota.order_current(rows), "status": quota.current_status(rows), "counters": counters}
    return {"rows": quota.order_windows(rows), "status": quota.row_status(rows), "counters": counters}


def _utc(moment: datetime) -> datetime:
    """Collected timestamps come back in the Python zone; make them explicit instants."""
    return moment.astimezone() if moment.tzinfo is None else moment


def detector_report(src: Sources, start, end, account_id=None) -> dict[str, DataFrame]:
    """Fast-mode candidates; recorded modes are left out on purpose."""
    scan = src.scan(start, end)
    found = scan.quota_samples(src.accounts, account_id=account_id, window_minutes=detector.FIVE_HOURS)
    result = detector.Detection(stage(found, "samples"), src.priced(scan, account_id, modes=False))
    return {"rows": result.candidates(), "reasons": result.reasons(), "diagnostics": result.counters()}


def health_report(src: Sources, now: datetime) -> dict[str, DataFrame]:
    scan = src.scan(now - timedelta(days=health.DAYS), now)
    priced = stage(pricing.price(scan.usage_records(), src.rates()), "priced")
    return {
        "usage": health.health_usage(priced, now),
        "unpriced_models": health.health_unpriced(priced, now),
        "quota": health.health_quota(scan.quota_samples(), now),
        "rate_card": pricing.inventory(src.rates()),
    }
