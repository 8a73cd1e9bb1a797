import os
import sys
from datetime import UTC, datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"

from tokentide.schemas import SAMPLES, USAGE  # noqa: E402
from tokentide.session import build_session  # noqa: E402

T0 = datetime(2026, 5, 10, tzinfo=UTC)


def at(hours=0, seconds=0, days=0):
    return T0 + timedelta(hours=hours, seconds=seconds, days=days)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture
def samples(spark):
    """Quota samples from (time, used, resets, and any other column)."""

    def build(*rows):
        base = dict(
            session_id="s", account_id="a", plan_type="pro", limit_id="l", window="7d", window_minutes=10080, source_path=None, source_line=None
        )
        made = []
        for n, (ts, used, resets, *more) in enumerate(rows):
            row = {**base, **(more[0] if more else {})}
            row.update(timestamp=ts, used_percent=float(used), remaining_percent=100.0 - used, resets_at=resets)
            made.append(row)
        names = [c.split()[0] for c in SAMPLES.split(", ")]
        return spark.createDataFrame([[r[n] for n in names] for r in made], SAMPLES)

    return build


@pytest.fixture
def usage(spark):
    """Usage records from (time, tokens, and any other column)."""

    def build(*rows):
        base = dict(
            session_id="s", model="gpt-5.5", fast=None, reasoning_effort=None, cwd="/w", account_id="a", file_path="/f", rate_limits=[]
        )
        made = []
        for n, (ts, tokens, *more) in enumerate(rows):
            row = {**base, "line_no": n + 1, **(more[0] if more else {})}
            counts = [tokens, 0, 0, 0, tokens]
            made.append(
                [ts, row["session_id"], row["model"], row["fast"], row["reasoning_effort"], row["cwd"], row["account_id"],
                 row["file_path"], row["line_no"], row["rate_limits"], *counts]
            )
        return spark.createDataFrame(made, USAGE)

    return build
