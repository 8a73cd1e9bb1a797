"""From a session folder to usage records, quota samples and scan diagnostics."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import diagnostics, fork, ingest
from tokentide.operators.parse import LIMIT_MARKS, USAGE_MARKS, marked, parse_lines
from tokentide.session import configure, stage
from tokentide.sources import logs, manifest


def _marks():
    return marked(*USAGE_MARKS, LIMIT_MARKS[0])


def _is_limit():
    return F.col("limits").isin("null", "other", "object")


class LogScan:
    """One pass over the logs of a range.

    Lines are read and parsed once; the typed events are staged as a table from
    which records, samples and counters are derived.

    With a `manifest` (the path of an index that reports share and add to), files known to end before the range stay closed, and
    the lines of known files are not counted again.
    """

    def __init__(
        self, spark: SparkSession, sessions_dir: str, start=None, end=None, full: bool = False, tz: str = "UTC", manifest: str | None = None
    ):
        self.manifest = manifest
        # Wall-clock parts are turned into instants under UTC; `tz` says whose clock they show.
        self.spark, self.sessions_dir, self.tz = configure(spark), sessions_dir, tz
        self.start, self.end, self.full = start, end, full
        self.range = None if start is None or end is None else logs.ScanRange(start, end, full)

    @cached_property
    def listing(self) -> logs.Listing:
        return logs.plan_listing(self.spark, self.sessions_dir, self.range, self.tz)

    @cached_property
    def files(self) -> DataFrame:
        return logs.list_logs(self.spark, self.sessions_dir, self.range, self.tz, self.listing)

    @cached_property
    def _lines(self) -> DataFrame:
        return logs.read_lines(self.spark, self.sessions_dir, self.range, self.tz, self.listing)

    @cached_property
    def splits(self) -> DataFrame:
        return stage(logs.splits(self._lines), "splits")

    def numbered(self, keep=None) -> DataFrame:
        return logs.number_lines(self._lines, keep, self.splits)

    @cached_property
    def events(self) -> DataFrame:
        if self.manifest is not None:
            return self._indexed[0]
        return stage(parse_lines(self.numbered(_marks())), "events")

    @cached_property
    def _indexed(self) -> tuple[DataFrame, DataFrame]:
        """Events of the files that a report may need, and the index rows of all files of the range."""
        wanted = stage(self.files.where(~F.col("action").startswith("skip")), "files")
        known = stage(manifest.current(wanted, manifest.load(self.spark, self.manifest)), "known")
        closed = known.select("file_path").limit(0)
        if self.range is not None:
            # A file is opened unless its last token count and its last quota sample both lie before the range.
            ends = [manifest.stale(known, self.start, c).select("file_path") for c in ("last_token", "last_limit")]
            closed = ends[0].join(ends[1], "file_path", "left_semi")
        parts, changed = [], wanted.select("file_path").limit(0)
        for paths in manifest.batches(known.join(closed, "file_path", "left_anti").select("file_path")):
            lines = stage(logs.read_files(self.spark, paths).where(_marks()), "marked")
            info = stage(manifest.split_info(lines, known), "splits")
            lost = info.where("first_row IS NULL").select("file_path").distinct()
            changed = changed.unionByName(lost)
            numbered = logs.number_lines(lines.join(lost, "file_path", "left_anti"), None, info)
            parts.append(stage(parse_lines(numbered), "events"))
        known = known.join(changed, "file_path", "left_anti")
        fresh = wanted.join(known, "file_path", "left_anti")
        found = [known]
        for mine, lines in self._fresh(fresh, known.isEmpty()):
            splits = stage(logs.splits(lines), "splits")
            events = stage(parse_lines(logs.number_lines(lines, _marks(), splits)), "events")
            rows = stage(manifest.facts(mine, splits, events, ingest.is_token_event(), _is_limit()), "facts")
            manifest.add(rows, self.manifest)
            parts.append(events)
            found.append(rows.select(known.columns))
        empty = parse_lines(self.spark.createDataFrame([], "file_path string, file_name string, block bigint, value string, line_no bigint"))
        return reduce(DataFrame.unionByName, parts or [empty]), reduce(DataFrame.unionByName, found)

    def _fresh(self, fresh: DataFrame, everything: bool):
        """Files that the index does not know, with their lines: the whole range at first, named files later."""
        if everything:
            yield fresh, self._lines
            return
        for paths in manifest.batches(fresh.select("file_path")):
            yield fresh.where(F.col("file_path").isin(paths)), logs.read_files(self.spark, paths)

    @cached_property
    def forks(self) -> DataFrame:
        """Forks among the files that hold usage of the range."""
        return self._forks(self.stale)

    @cached_property
    def limit_forks(self) -> DataFrame:
        """Forks among the files that hold quota samples of the range."""
        return self.forks if self.range is None else self._forks(self.stale_limits)

    def _forks(self, stale: DataFrame | None) -> DataFrame:
        # Files that turned out stale are neither forks nor parents by their first line.
        found = stage(fork.parents(fork.lineage(self._kept(stale)), self._all_names), "forks")
        if found.where(F.col("parent_path").isNotNull()).isEmpty():
            return found.withColumn("replay_prefix_lines", F.lit(0).cast("long"))
        outside = found.where(F.col("parent_path").isNotNull()).select("parent_path").distinct()
        if self.manifest is not None:
            # Just the forks and their parents are read, once.
            paths = found.where(F.col("parent_path").isNotNull()).select(F.explode(F.array("file_path", "parent_path"))).distinct()
            return stage(fork.replay_prefix(found, self._whole(paths)), "replay")
        # Parents older than the range: just these files are read.
        scanned = self.splits.select(F.col("file_path").alias("parent_path")).distinct()
        lines, older = self.numbered(), outside.join(scanned, "parent_path", "left_anti")
        return stage(fork.replay_prefix(found, lines, None if older.isEmpty() else self._whole(older)), "replay")

    def _whole(self, paths: DataFrame) -> DataFrame:
        """All lines of the named files, numbered; read in batches of bounded size and staged."""
        parts = []
        for some in manifest.batches(paths):
            lines = stage(logs.read_files(self.spark, some), "whole")
            parts.append(logs.number_lines(lines))
        return reduce(DataFrame.unionByName, parts)

    def _all_names(self) -> DataFrame:
        return logs.list_logs(self.spark, self.sessions_dir).select("file_path", "file_name")

    @cached_property
    def stale(self) -> DataFrame | None:
        """Tail candidates whose last token count lies before the range."""
        if self.range is None:
            return None
        if self.manifest is not None:
            return manifest.stale(self._indexed[1], self.start, "last_token")
        return ingest.stale_files(self.events, self.files, self.start, ingest.is_token_event())

    @cached_property
    def stale_limits(self) -> DataFrame | None:
        if self.range is None:
            return None
        if self.manifest is not None:
            return manifest.stale(self._indexed[1], self.start, "last_limit")
        return ingest.stale_files(self.events, self.files, self.start, _is_limit(), "sample_time")

    def _kept(self, stale: DataFrame | None) -> DataFrame:
        return self.events if stale is None else ingest.drop_files(self.events, stale)

    def token_events(self, accounts=None, modes=None, account_id: str | None = None) -> DataFrame:
        return ingest.token_events(
            self._kept(self.stale), self.forks, accounts, modes, self.start, self.end, account_id
        )

    def usage_records(self, accounts=None, modes=None, account_id: str | None = None) -> DataFrame:
        """Usage records of the range; histories are (switches, default) pairs."""
        return self.token_events(accounts, modes, account_id).where("skip_reason IS NULL").drop("skip_reason")

    def sample_events(self, accounts=None, **filters) -> DataFrame:
        return ingest.sample_events(
            self._kept(self.stale_limits), self.limit_forks, accounts, self.start, self.end, **filters
        )

    def quota_samples(self, accounts=None, **filters) -> DataFrame:
        return self.sample_events(accounts, **filters).where("skip_reason IS NULL").drop("skip_reason")

    def _lines_read(self, stale: DataFrame | None) -> DataFrame:
        counted = self.splits if self.manifest is None else self._indexed[1]
        kept = counted if stale is None else counted.join(stale.select("file_path"), "file_path", "left_anti")
        return kept.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("read_lines"))

    def usage_diagnostics(self, accounts=None, modes=None, account_id: str | None = None) -> DataFrame:
        return diagnostics.side_by_side(
            diagnostics.file_counters(self.files, self.stale, self.listing),
            fork.fork_counters(self.forks),
            self._lines_read(self.stale),
            diagnostics.usage_line_counters(self._kept(self.stale)),
            diagnostics.skip_counters(self.token_events(accounts, modes, account_id)),
        )

    def sample_diagnostics(self, accounts=None, **filters) -> DataFrame:
        events = ingest.with_forks(self._kept(self.stale_limits), self.limit_forks)
        return diagnostics.side_by_side(
            diagnostics.file_counters(self.files, self.stale_limits, self.listing),
            fork.fork_counters(self.limit_forks),
            self._lines_read(self.stale_limits),
            diagnostics.sample_line_counters(events),
            diagnostics.limit_only_files(events),
            diagnostics.sample_filter_counters(self.sample_events(accounts, **filters)),
        )
