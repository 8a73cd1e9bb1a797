"""The compact timeline of sessions."""

from tests.conftest import at
from tokentide.operators import sessions

ORDER_ONLY = {"file_path", "line_no", "cwd", "fast", "usd", "chunk"}


def priced(usage, *rows):
    from pyspark.sql import functions as F

    return usage(*rows).withColumns({"credits": F.lit("1.5").cast("decimal(38,12)"), "priced": F.lit(True)})


def test_compact_rows_carry_no_columns_that_only_order_them(usage, monkeypatch):
    seen = []
    stage = sessions.stage
    monkeypatch.setattr(sessions, "stage", lambda df, name: seen.append(df.columns) or stage(df, name))
    rows = [(at(n), 10, {"model": "m" if n < 3 else "o", "line_no": 9 - n}) for n in range(5)]
    out = sessions.session_compact(sessions.session_events(priced(usage, *rows)), 3).collect()
    assert [(r["run"], r["bucket"], r["events"], r["model"], r["credits"], r["usd"]) for r in out] == [
        (1, 0, 1, "m", 1.5, 0.06), (1, 1, 2, "m", 3.0, 0.12), (2, 0, 2, "o", 3.0, 0.12),
    ]
    assert seen and not any(ORDER_ONLY & set(columns) for columns in seen)


def test_compact_of_one_instant_follows_files_and_lines(usage):
    rows = [(at(0), n, {"file_path": f, "line_no": n, "reasoning_effort": e}) for f, n, e in (("/b", 1, "low"), ("/a", 2, None), ("/a", 1, "low"))]
    out = sessions.session_compact(sessions.session_events(priced(usage, *rows)), 20).collect()
    assert [(r["run"], r["reasoning_effort"], r["total_tokens"]) for r in out] == [(1, "low", 1), (2, None, 2), (3, "low", 1)]
