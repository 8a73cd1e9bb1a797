"""Usage kept as partial aggregates: long reports read closed times from a table of sums instead of from records.

A row has the sums of one session's records of one quarter hour that agree in model, mode, effort, folder and account. Such rows add up to
every report, and sessions are still told apart, so their counts stay exact. A quarter of an hour is the longest time that no
time zone's days or hours cut.

Times are closed in order, each once: closing is an append to a store of numbered commits, so two closers don't
count twice. Records that arrive for a time already closed are not seen; close late enough.
"""

from __future__ import annotations

from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.operators.usage import MEASURES, _rows, group_key, measures, order_rows, roll_up
from tokentide.sources.history_store import HistoryStore, VersionConflict

QUARTER = 900
DIMENSIONS = ("model", "fast", "reasoning_effort", "cwd", "account_id", "session_id")
SCHEMA = (
    "timestamp timestamp, model string, fast boolean, reasoning_effort string, cwd string, account_id string, session_id string, calls bigint, "
    "input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint, "
    "credits decimal(38,12), priced_calls bigint, unpriced_calls bigint, until timestamp, pos bigint"
)


def partials(priced: DataFrame) -> DataFrame:
    """Sums per quarter hour (`timestamp`, its start) and everything a report can group by."""
    start = F.timestamp_micros(F.floor(F.unix_micros("timestamp") / (QUARTER * 1_000_000)) * (QUARTER * 1_000_000))
    keyed = priced.withColumn("timestamp", start)
    return keyed.groupBy("timestamp", *DIMENSIONS).agg(*measures()).withColumn("credits", F.col("credits").cast("decimal(38,12)"))


def _whole(time: datetime) -> datetime:
    time = time if time.tzinfo else time.replace(tzinfo=UTC)
    if time.timestamp() % QUARTER:
        raise ValueError(f"times are closed by quarter hours: {time}")
    return time


class KeptUsage:
    """The table of one folder."""

    def __init__(self, store: HistoryStore):
        self.store = store

    @classmethod
    def at(cls, spark, folder: str) -> KeptUsage:
        return cls(HistoryStore(spark, folder, SCHEMA))

    def read(self) -> tuple[int, DataFrame, datetime | None]:
        """Version, sums, and the time up to which all is closed."""
        version, rows = self.store.read()
        until = rows.agg(F.unix_micros(F.max("until")).alias("us")).first().us if version else None
        # Each commit has a row without a session that only says how far it goes.
        return version, rows.where("calls IS NOT NULL").drop("until", "pos"), None if until is None else datetime.fromtimestamp(until / 1e6, UTC)

    def close(self, priced: DataFrame, until: datetime) -> int:
        """Adds the sums of all records since the last close and before `until`."""
        until = _whole(until)
        while True:
            version, _, since = self.read()
            if since is not None and since >= until:
                return version
            new = priced.where(F.col("timestamp") < F.lit(until))
            new = partials(new if since is None else new.where(F.col("timestamp") >= F.lit(since)))
            mark = new.limit(0).unionByName(priced.sparkSession.range(1).select(F.lit(until).alias("timestamp")), allowMissingColumns=True)
            rows = new.unionByName(mark).withColumn("until", F.lit(until).cast("timestamp"))
            try:
                return self.store.append(rows, f"close {until.isoformat()}", version)
            except VersionConflict:
                continue

    def usage_by(
        self, priced: DataFrame, group: str, start: datetime | None = None, end: datetime | None = None, effort: bool = False,
        tz: str | None = None, sort: str | None = None, credits_per_usd: Decimal = Decimal(25),
    ) -> DataFrame:
        """`usage.usage_by` over [start, end): closed quarter hours from the table, the rest from `priced`.

        Of closed times only records of a quarter hour that `start` or `end` cuts are read.
        """
        _, sums, closed = self.read()
        low, high, shut = _micros(start), _micros(end), _micros(closed)
        rest, step = _between(priced, low, high), QUARTER * 1_000_000
        # The closed quarter hours that lie in the range as a whole.
        begin = None if low is None else -(-low // step) * step
        stop = shut if high is None or shut is None else min(shut, high // step * step)
        if stop is None or (begin is not None and begin >= stop):
            whole = sums.limit(0)
        else:
            whole = _between(sums, begin, stop)
            outside = F.col("timestamp") >= F.timestamp_micros(F.lit(stop))
            rest = rest.where(outside if begin is None else outside | (F.col("timestamp") < F.timestamp_micros(F.lit(begin))))
        parts = whole.unionByName(partials(rest).select(*whole.columns))
        key = group_key(group, effort, tz).alias("key")
        per_session = parts.groupBy(key, "session_id").agg(*roll_up()).select("key", "session_id", *MEASURES)
        return order_rows(_rows(per_session, credits_per_usd), group, sort)


def _micros(time: datetime | None) -> int | None:
    return None if time is None else int(time.replace(tzinfo=time.tzinfo or UTC).timestamp()) * 1_000_000 + time.microsecond


def _between(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        rows = rows.where(F.col("timestamp") >= F.timestamp_micros(F.lit(low)))
    if high is not None:
        rows = rows.where(F.col("timestamp") < F.timestamp_micros(F.lit(high)))
    return rows
