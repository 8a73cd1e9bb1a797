import pytest
from pyspark.sql import functions as F

from tokentide.operators import pricing, usage as U
from tokentide.operators.kept import KeptUsage

from conftest import at


@pytest.fixture
def records(usage):
    rows = [(at(seconds=701 * i), i + 1, {"session_id": "s%d" % (i % 4), "cwd": "/w%d" % (i % 3), "account_id": None if i % 5 else "a", "model": "gpt-5.5" if i % 2 else "odd"}) for i in range(60)]
    return pricing.price(usage(*rows, (at(3), 5, {"session_id": None, "fast": True})))


def test_reports_equal_those_from_records(spark, records, tmp_path):
    kept = KeptUsage.at(spark, str(tmp_path / "kept"))
    day = lambda rows: sorted(map(tuple, rows.collect()), key=repr)
    assert day(kept.usage_by(records, "hour")) == day(U.usage_by(records, "hour"))
    assert kept.close(records, at(4)) == 1 and kept.close(records, at(7)) == 2
    # Closing again, or an earlier time, adds nothing.
    assert kept.close(records, at(7)) == 2 and kept.close(records, at(5)) == 2
    with pytest.raises(ValueError):
        kept.close(records, at(8, seconds=1))
    for group, zone in (("hour", "Asia/Kathmandu"), ("day", None), ("model", None), ("account", None)):
        assert day(kept.usage_by(records, group, tz=zone)) == day(U.usage_by(records, group, tz=zone)), group
    cuts = [(at(0), at(2)), (at(1, seconds=5), at(9, seconds=7)), (at(8), at(9)), (at(2, seconds=1), at(2, seconds=9)), (None, at(6, seconds=30)), (at(6, seconds=30), None)]
    for start, end in cuts:
        inside = records.where(F.lit(True) if start is None else F.col("timestamp") >= F.lit(start)).where(F.lit(True) if end is None else F.col("timestamp") < F.lit(end))
        assert day(kept.usage_by(records, "cwd", start, end)) == day(U.usage_by(inside, "cwd")), (start, end)


def test_closed_records_are_not_read(spark, records, tmp_path):
    kept = KeptUsage.at(spark, str(tmp_path / "kept"))
    kept.close(records, at(7))
    want = U.usage_by(records, "cwd").collect()
    left = records.where(F.col("timestamp") >= F.lit(at(7)))
    assert kept.usage_by(left, "cwd").collect() == want
    # The filter reaches a scan of the records.
    left.write.parquet(str(tmp_path / "records"))
    plan = kept.usage_by(spark.read.parquet(str(tmp_path / "records")), "cwd")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp" in plan
