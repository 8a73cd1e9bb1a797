import random
from datetime import timedelta

from pyspark.sql import functions as F

from tokentide.operators import islands, quota

from conftest import at


def test_merged_parts_equal_the_whole(samples):
    rng = random.Random(12)
    rows = []
    for s in range(4):
        reset = at(days=7)
        for i in range(60):
            reset += timedelta(seconds=rng.choice([0, 0, 20, 59, 70, -30, 5000]))
            used = 0.0 if s == 3 else float(rng.randrange(40))
            resets = at(seconds=900 * i) + timedelta(days=7) if s == 3 else reset
            rows.append((at(seconds=900 * i), used, resets, {"limit_id": None if s == 0 else f"l{s}", "session_id": "s%d" % rng.randrange(3)}))
    # Two samples of one instant, and a copy.
    rows += [(at(seconds=900 * 5), 7.0, at(days=7, seconds=1), {"limit_id": "l1"}), (*rows[70][:3], {"limit_id": "l1", "session_id": "zz"})]
    df = samples(*rows)
    columns = quota.quota_windows(df).columns
    look = lambda found: sorted((tuple(r) for r in found.select(columns).collect()), key=repr)
    want = look(quota.quota_windows(df))
    assert len(want) > 30 and not [w for w in want if "l3" in w]
    hours = F.floor(F.unix_seconds("timestamp") / 3600)
    assert look(islands.windows_of(islands.window_parts(df, hours))) == want
    cuts = [at(0), at(3), at(3, seconds=450), at(9), at(99)]
    parts = [islands.window_parts(df.where((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(b)))) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = islands.merge_parts(islands.merge_parts(parts[0], parts[1]), islands.merge_parts(parts[2], parts[3]))
    assert look(islands.windows_of(left)) == want
    assert left.count() <= sum(p.count() for p in parts)
