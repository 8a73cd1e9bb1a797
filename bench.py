"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokentide.plans.registry import QUERIES  # noqa: E402
from tokentide.session import build_session  # noqa: E402

HEADLINE = (
    "usage_by_model",
    "usage_by_month",
    "usage_by_account",
    "usage_totals",
    "sessions_top",
    "session_switches",
    "quota_windows",
    "quota_current",
    "quota_trend",
    "windows_usage_attach",
    "limit_usage_window",
    "detector_candidates",
    "usage_records",
    "usage_diagnostics",
    "fork_replay",
    "health_usage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    QUERIES["usage_by_day"](spark, sf_dir).count()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
