"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tokentide.plans.oracles import SQL
from tokentide.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = (
    "usage_by_week", "usage_totals", "sessions_top", "session_compact", "samples_dedup", "quota_resets",
    "quota_trend", "limit_usage_account", "detector_reasons", "skip_reasons", "file_prune", "fork_replay",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, names):
    order = sorted(names)
    place = [names.index(c) for c in order]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(row[i]) for i in place) for row in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), names)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
