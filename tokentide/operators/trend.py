"""Change points of quota use: first sight, reset moves and increases of each stream.

The rule is a fold - a sample counts only against the last *accepted* one - but
almost all of it parallelises:

* A sample whose reset jumps by twice the jitter from its predecessor is always
  accepted, so such samples cut a stream into segments that fold independently.
* In a segment whose resets all lie within the jitter only growth of `used_percent`
  matters, so the first row of each distinct value is enough, and of those only
  the strict running maxima.
* What is left (resets that creep, or values that grow by less than the epsilon)
  is folded in blocks of bounded size. A block finds the next accepted row of each
  row by range search, and is reduced to the few states it can hand on; composing
  these gives the state that comes into each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.functions.scalars import JITTER_MICROS, PERCENT_EPSILON
from tokentide.operators.chunked import linked, time_chunk
from tokentide.operators.samples import STREAM_FIELDS, active_samples
from tokentide.session import stage

BLOCK_ROWS = 500_000
ORDER = ("timestamp", "source_path", "source_line", "session_id")
SEGMENT = (*STREAM_FIELDS, "run")


def observations(samples: DataFrame) -> DataFrame:
    """One row per log line: the vector of all quota windows it reports."""
    key = ("account_id", "plan_type", "limit_id", *ORDER)
    window = F.struct("window_minutes", "used_percent", "remaining_percent", "resets_at", "window")
    plain = active_samples(samples).withColumns(
        {"source_path": F.coalesce("source_path", F.lit("")), "source_line": F.coalesce("source_line", F.lit(0))}
    )
    # One entry per window length, so the list is as short as the line's window names.
    per_window = plain.groupBy(*key, "window_minutes").agg(F.max_by(window, "resets_at").alias("w"))
    return per_window.groupBy(*key).agg(F.array_sort(F.collect_list("w")).alias("windows"))


def compact_observations(obs: DataFrame) -> DataFrame:
    """Drops observations that repeat the preceding one of the same source."""
    source = F.coalesce(F.nullif("source_path", F.lit("")), F.col("session_id"))
    rows = obs.withColumns(
        {
            "source": F.struct("account_id", "plan_type", "limit_id", source.alias("source")),
            "chunk": time_chunk("timestamp"),
            "vector": F.transform(
                "windows",
                lambda w: F.struct(w["window_minutes"], w["used_percent"], w["remaining_percent"], w["resets_at"]),
            ),
        }
    )
    repeated = F.col("prev.vector") == F.col("vector")
    rows = linked(rows, ["source"], "chunk", ORDER, ["vector"])
    return rows.where(F.col("prev").isNull() | ~repeated).drop("source", "chunk", "vector", "prev", "rn")


def _segments(obs: DataFrame) -> DataFrame:
    """Live samples with their segment `run` and whether its resets stay within the jitter."""
    live = (
        obs.select(*[c for c in obs.columns if c != "windows"], F.inline("windows"))
        .where(F.col("resets_at") > F.col("timestamp"))
        .withColumns({"stream": F.struct(*STREAM_FIELDS), "chunk": time_chunk("timestamp")})
    )

    def jumps(prev, cur):
        return F.abs(F.unix_micros(prev["resets_at"]) - F.unix_micros(cur["resets_at"])) >= 2 * JITTER_MICROS

    rows = linked(stage(live, "trend"), ["stream"], "chunk", ORDER, ["resets_at"], jumps)
    rows = stage(rows.drop("prev"), "segments")
    whole = Window.partitionBy("stream", "run")
    spans = rows.groupBy("stream", "run", "chunk").agg(
        F.min(F.unix_micros("resets_at")).alias("lo"), F.max(F.unix_micros("resets_at")).alias("hi"), F.min("rn").alias("rn0")
    )
    spans = spans.select(
        "stream",
        "run",
        "chunk",
        (F.max("hi").over(whole) - F.min("lo").over(whole) < JITTER_MICROS).alias("steady"),
        F.min("rn0").over(whole).alias("rn0"),
    )
    return rows.join(spans, ["stream", "run", "chunk"]).drop("stream", "chunk")


def _records(steady: DataFrame) -> DataFrame:
    """Strict running maxima of each steady segment, and whether any grows by less than epsilon."""
    rest = [c for c in steady.columns if c not in (*SEGMENT, "used_percent")]
    firsts = (
        steady.groupBy(*SEGMENT, "used_percent")
        .agg(F.min_by(F.struct(*rest), "rn").alias("s"))
        .select(*SEGMENT, "used_percent", "s.*")
    )
    # Distinct percent values of one quota window: a short list.
    earlier = Window.partitionBy(*SEGMENT).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    top = firsts.withColumn("top", F.max("used_percent").over(earlier))
    top = top.where(F.col("top").isNull() | (F.col("used_percent") > F.col("top")))
    creeps = F.coalesce(F.col("used_percent") - F.col("top") <= PERCENT_EPSILON, F.lit(False))
    return top.withColumn("creeps", F.max(creeps).over(Window.partitionBy(*SEGMENT))).drop("top")


_KEY = (*SEGMENT, "block")
_KEY_SQL = "account_id string, plan_type string, limit_id string, window_minutes bigint, run bigint, block bigint"
_NO_TIME = np.iinfo(np.int64)


def _counts(used: np.ndarray, reset: np.ndarray, from_used: np.ndarray, from_reset: np.ndarray) -> np.ndarray:
    """Whether samples count against states: the reset moved by the jitter at least, or the use grew by more than epsilon."""
    return (np.abs(reset - from_reset) >= JITTER_MICROS) | (used - from_used > PERCENT_EPSILON)


class _Ranges:
    """Extremes of aligned ranges of 1, 2, 4, ... rows, to find the next row that counts against a state in log time.

    Some row of a range counts exactly if its largest or smallest reset or its largest use does.
    """

    def __init__(self, used: np.ndarray, reset: np.ndarray):
        self.n = len(used)
        size = 1 << max(1, (self.n - 1).bit_length())
        top, low, most = np.full(size, _NO_TIME.min), np.full(size, _NO_TIME.max), np.full(size, -np.inf)
        top[: self.n], low[: self.n] = reset, reset
        most[: self.n] = np.where(np.isnan(used), -np.inf, used)
        self.levels = [(top, low, most)]
        while len(top) > 1:
            top, low, most = np.maximum(top[::2], top[1::2]), np.minimum(low[::2], low[1::2]), np.maximum(most[::2], most[1::2])
            self.levels.append((top, low, most))

    def _hit(self, level: int, node: np.ndarray, used: np.ndarray, reset: np.ndarray) -> np.ndarray:
        top, low, most = (x[node] for x in self.levels[level])
        filled = top >= low
        # Where nothing is filled in, the reset itself stands in for the extremes.
        top, low = np.where(filled, top, reset), np.where(filled, low, reset)
        return (top - reset >= JITTER_MICROS) | (reset - low >= JITTER_MICROS) | (most - used > PERCENT_EPSILON)

    def following(self, at: np.ndarray, used: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """For each state the first row from `at` on that counts against it, or the number of rows."""
        at, size = at.copy(), len(self.levels[0][0])
        level = np.full(len(at), -1)
        open_ = np.flatnonzero(at < self.n)
        # Upwards: a right child is searched before its parent's next sibling.
        for k in range(len(self.levels)):
            odd = open_[(at[open_] >> k) & 1 == 1] if k + 1 < len(self.levels) else open_[at[open_] < size]
            hit = self._hit(k, at[odd] >> k, used[odd], reset[odd])
            level[odd[hit]] = k
            at[odd[~hit]] += 1 << k
            open_ = open_[(level[open_] < 0) & (at[open_] < self.n)]
            if not len(open_):
                break
        # Downwards, into the half that has the first one.
        for k in range(len(self.levels) - 2, -1, -1):
            below = np.flatnonzero(level > k)
            miss = ~self._hit(k, at[below] >> k, used[below], reset[below])
            at[below[miss]] += 1 << k
        return np.where(level >= 0, at, self.n)


def _next_accepted(used: np.ndarray, reset: np.ndarray) -> tuple[_Ranges, list[int]]:
    """For each row the next one that is accepted after it, or the number of rows."""
    ranges = _Ranges(used, reset)
    return ranges, ranges.following(np.arange(1, len(used) + 1), used, reset).tolist()


def _ordered(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    block = block.sort_by("rn")
    return block, block.column("used_percent").to_numpy(), block.column("resets_us").to_numpy()


def _keyed(block: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    """`columns` with the key of `block` in every row."""
    n = len(next(iter(columns.values())))
    keys = {c: pa.nulls(n, block.schema.field(c).type) if (v := block.column(c)[0]).as_py() is None else pa.repeat(v, n) for c in _KEY}
    return pa.table({**keys, **columns})


def _accept(block: pa.Table) -> pa.Table:
    """Accepted rows of one block; `state_*` is the last accepted sample before it, null if there is none."""
    block, used, reset = _ordered(block)
    ranges, after = _next_accepted(used, reset)
    at = 0
    if (u := block.column("state_used")[0].as_py()) is not None:
        r = block.column("state_reset")[0].as_py()
        at = int(ranges.following(np.zeros(1, np.int64), np.array([u]), np.array([r]))[0])
    taken = []
    while at < len(used):
        taken.append(at)
        at = after[at]
    return _keyed(block, {"rn": block.column("rn").take(pa.array(taken, pa.int64()))})


def _transfer(block: pa.Table) -> pa.Table:
    """What a block makes of the states that may come in: for each row that can be accepted first, the row accepted last.

    States that come in lie within the jitter of the last sample before the block (`before_reset`), else that sample would have been
    accepted; so the first accepted row is at most the first whose reset is twice the jitter away from it. It also is an
    extreme of the block so far, since no row before it was accepted.
    """
    block, used, reset = _ordered(block)
    _, after = _next_accepted(used, reset)
    n = len(used)
    last = list(range(n))
    for k in range(n - 1, -1, -1):
        if after[k] < n:
            last[k] = last[after[k]]
    if (before := block.column("before_reset")[0].as_py()) is None:
        first = np.zeros(1, np.int64)
    else:
        away = np.flatnonzero(np.abs(reset - before) >= 2 * JITTER_MICROS)
        end = int(away[0]) + 1 if len(away) else n
        u, r = used[:end], reset[:end]
        top, low, most = np.maximum.accumulate(r), np.minimum.accumulate(r), np.fmax.accumulate(u)
        new = np.ones(end, bool)
        new[1:] = (r[1:] > top[:-1]) | (r[1:] < low[:-1]) | (u[1:] > most[:-1])
        first = np.flatnonzero(new)
    exits = np.array(last)[first]
    return _keyed(
        block,
        {"at": pa.array(first), "used": pa.array(used[first]), "reset": pa.array(reset[first]), "exit_used": pa.array(used[exits]), "exit_reset": pa.array(reset[exits])},
    )


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that comes into each block, from the transfer rows of whole segments in order; one block is held at a time."""

    def blocks() -> Iterator[tuple[tuple, pa.Table]]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in _KEY], strict=True))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[begin]:
                    if keys[begin] != key and held:
                        yield key, pa.Table.from_batches(held)
                        held = []
                    key = keys[begin]
                    held.append(batch.slice(begin, k - begin))
                    begin = k
        if held:
            yield key, pa.Table.from_batches(held)

    segment, state = None, None
    for key, table in blocks():
        used, reset = table.column("used").to_numpy(), table.column("reset").to_numpy()
        if key[:-1] != segment:
            segment, state, found = key[:-1], None, 0
        else:
            u, r = state
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v], t) for v, t in zip(key, _KEY_TYPES, strict=True)], pa.array([u], pa.float64()), pa.array([r], pa.int64())],
                names=[*_KEY, "state_used", "state_reset"],
            )
            fits = _counts(used, reset, u, r)
            found = int(fits.argmax()) if fits.any() else None
        if found is not None:
            state = (float(table.column("exit_used")[found].as_py()), int(table.column("exit_reset")[found].as_py()))


_KEY_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())


def _fold(rows: DataFrame, block_rows: int) -> DataFrame | None:
    """Accepted rows of the segments that need the row-by-row fold; None when there are none.

    Blocks of bounded size are worked through at once. Where a segment has several, each block is first reduced to the few
    states it can hand on; composing these in order gives the state that comes into each block.
    """
    rows = stage(rows.withColumn("block", F.expr(f"(rn - rn0) div {block_rows}")), "fold")
    if rows.isEmpty():
        return None
    slim = rows.select(*_KEY, F.struct(*SEGMENT).alias("segment"), "rn", "used_percent", F.unix_micros("resets_at").alias("resets_us"))
    ends = slim.groupBy("segment", "block").agg(F.max_by("resets_us", "rn").alias("reset"))
    before = ends.select("segment", (F.col("block") + 1).alias("block"), F.col("reset").alias("before_reset"))
    several = stage(ends.groupBy("segment").agg(F.max("block").alias("blocks")).where("blocks > 0").select("segment"), "several")
    if several.isEmpty():
        states = slim.sparkSession.createDataFrame([], f"{_KEY_SQL}, state_used double, state_reset bigint")
    else:
        many = slim.join(several, "segment").join(before, ["segment", "block"], "left").drop("segment")
        tables = many.groupBy(*_KEY).applyInArrow(
            _transfer, f"{_KEY_SQL}, at bigint, used double, reset bigint, exit_used double, exit_reset bigint"
        )
        ordered = tables.repartition(*SEGMENT).sortWithinPartitions(*_KEY, "at")
        states = stage(ordered.mapInArrow(_compose, f"{_KEY_SQL}, state_used double, state_reset bigint"), "states")
    states = states.select(F.struct(*SEGMENT).alias("segment"), "block", "state_used", "state_reset")
    given = slim.join(states, ["segment", "block"], "left").drop("segment")
    taken = given.groupBy(*_KEY).applyInArrow(_accept, f"{_KEY_SQL}, rn bigint")
    same = [rows[c].eqNullSafe(taken[c]) for c in (*SEGMENT, "rn")]
    return rows.drop("block").join(taken, same, "left_semi")


def quota_trend(samples: DataFrame, window_minutes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Accepted changes with their kind and the growth since the previous accepted sample."""
    rows = _segments(compact_observations(observations(samples)))
    if window_minutes is not None:
        # Window lengths fold independently, so the filter may come first.
        rows = rows.where(F.col("window_minutes") == window_minutes)
    records = _records(rows.where(F.col("steady")))
    columns = [c for c in records.columns if c != "creeps"]
    accepted = records.where(~F.col("creeps")).select(columns)
    loose = rows.where(~F.col("steady")).select(columns).unionByName(records.where(F.col("creeps")).select(columns))
    folded = _fold(loose, block_rows)
    if folded is not None:
        accepted = accepted.unionByName(folded.select(columns))
    keyed = accepted.withColumns({"stream": F.struct(*STREAM_FIELDS), "chunk": time_chunk("timestamp")})
    changes = linked(keyed.drop("rn"), ["stream"], "chunk", ORDER, ["used_percent", "resets_at"])
    moved = F.abs(F.unix_micros("prev.resets_at") - F.unix_micros("resets_at")) >= JITTER_MICROS
    return changes.select(
        F.col("timestamp").alias("at"),
        "account_id",
        "plan_type",
        "limit_id",
        "window",
        "window_minutes",
        "used_percent",
        "remaining_percent",
        (F.col("used_percent") - F.col("prev.used_percent")).alias("delta_used_percent"),
        "resets_at",
        F.when(F.col("prev").isNull(), "firstObserved").when(moved, "resetChanged").otherwise("increased").alias("kind"),
    )
