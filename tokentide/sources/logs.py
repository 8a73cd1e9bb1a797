"""Session log trees: listing, pruning and ordered lines.

Layout: `<root>/YYYY/MM/DD/rollout-<local time>-<session id>.jsonl`, plus a sibling
`archived_sessions` folder of any shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentide.session import stage

DAY = timedelta(days=1)
MIN_LOOKBACK, MAX_LOOKBACK = 7 * DAY, 30 * DAY
ARCHIVE = "archived_sessions"
# Folders of the upper levels that the driver lists at once; files are listed by executors.
LISTERS = 16
NAME_TIME = r"^rollout-(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).*\.jsonl$"


@dataclass(frozen=True)
class ScanRange:
    """Report range and how far before its start files are still worth reading."""

    start: datetime
    end: datetime
    full: bool = False

    @property
    def lookback_start(self) -> datetime:
        half = max(self.end - self.start, timedelta(0)) / 2
        return self.start - min(max(half, MIN_LOOKBACK), MAX_LOOKBACK)


def roots_of(sessions_dir: str) -> list[str]:
    """The session root and, if it is another folder, the archive beside it."""
    base = sessions_dir.rstrip("/")
    parent, _, name = base.rpartition("/")
    return [base] if name == ARCHIVE else [base, f"{parent}/{ARCHIVE}"]


def _existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that are there; a missing root is an empty one. Nothing below them is listed."""
    found = []
    for root in roots:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found.append(root)
    return found


def _reader(spark: SparkSession, fmt: str):
    return (
        spark.read.format(fmt)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
    )


# --- pruning ----------------------------------------------------------------


def _local(*parts: Column, tz: str) -> Column:
    """Local wall-clock parts as an instant; null when they form no valid time."""
    text = F.format_string("%s-%s-%s %s:%s:%s", *parts)
    return F.to_utc_timestamp(text.try_cast("timestamp_ntz").cast("timestamp"), tz)


def name_time(name: Column, tz: str = "UTC") -> Column:
    """Start time written in a log's file name; null when the name has none."""
    return _local(*[F.nullif(F.regexp_extract(name, NAME_TIME, i), F.lit("")) for i in range(1, 7)], tz=tz)


def _dated(relative: Column, depth: int, tz: str) -> Column:
    """Start of the date folder `depth` levels deep; null when the folders are no date."""
    pattern = r"^(\d{4})" + "".join(r"/(\d{2})" for _ in range(depth - 1)) + "/"
    parts = [F.nullif(F.regexp_extract(relative, pattern, i), F.lit("")) for i in range(1, depth + 1)]
    parts += [F.lit("01")] * (3 - depth)
    return _local(*parts, *[F.lit("00")] * 3, tz=tz)


def in_future_folder(relative: Column, end: datetime, tz: str = "UTC") -> Column:
    """The file lies in a year, month or day folder that starts after the range."""
    later = [F.coalesce(_dated(relative, depth, tz) > F.lit(end), F.lit(False)) for depth in (1, 2, 3)]
    return later[0] | later[1] | later[2]


def file_action(name: Column, relative: Column, mtime: Column, scan: ScanRange, tz: str = "UTC") -> Column:
    """What to do with a file: read, tail (read if its last event is in range), or why it is skipped."""
    written = name_time(name, tz)
    recent = F.lit(scan.full) | (written >= F.lit(scan.lookback_start))
    return (
        F.when(in_future_folder(relative, scan.end, tz), "skip_folder")
        .when(written.isNull(), "read")
        .when(written > F.lit(scan.end), "skip_late")
        .when(written >= F.lit(scan.start), "read")
        .when(recent, "tail")
        .when(mtime >= F.lit(scan.start), "tail_mtime")
        .otherwise("skip_old")
    )


def path_session_id(name: Column, path: Column) -> Column:
    """Session id in a file name: what follows `rollout-` and the 20 characters of the time."""
    return F.when(
        name.rlike(r"^rollout-.{20,}\.jsonl$"), F.regexp_extract(name, r"^rollout-.{20}(.*)\.jsonl$", 1)
    ).otherwise(path)


def _located(df: DataFrame, roots: list[str], path: Column) -> DataFrame:
    """Adds `root` and `relative` for files below the given roots."""
    plain = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^([a-z0-9]+:)?//[^/]*", "")
    bare = [r.split("://", 1)[-1] for r in roots]
    root = F.coalesce(*[F.when(plain.contains(b + "/"), F.lit(r)) for r, b in zip(roots, bare)], F.lit(roots[0]))
    relative = F.coalesce(
        *[F.when(plain.contains(b + "/"), F.substring_index(plain, b + "/", -1)) for b in bare], plain
    )
    return df.withColumn("root", root).withColumn("relative", relative)


@dataclass(frozen=True)
class Listing:
    """What a range leaves to list: folders to search with all below them and file patterns; and what it took to find out."""

    roots: list[str]
    paths: list[str]
    opened: int = 0
    skipped: int = 0


def _folder_start(parts: tuple[str, ...], tz: str) -> datetime | None:
    """Start of a year, month or day folder; null when its parts are no date."""
    try:
        return datetime(*[int(p) for p in (*parts, "1", "1")[:3]], tzinfo=ZoneInfo(tz))
    except ValueError:
        return None


def _date_parts(parts: tuple[str, ...] | None, name: str) -> tuple[str, ...] | None:
    """Date parts of a folder below one with `parts`; null when the name is no further part."""
    if parts is None or not re.fullmatch(r"[0-9]{4}" if not parts else r"[0-9]{2}", name):
        return None
    return (*parts, name)


def _children(spark: SparkSession, folder: str) -> Iterator[tuple[str, str, bool]]:
    """Path, name and whether it is a folder, of each visible entry of one folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(path)
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            yield status.getPath().toString(), name, status.isDirectory()


def _literal(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def plan_listing(spark: SparkSession, sessions_dir: str, scan: ScanRange | None = None, tz: str = "UTC") -> Listing:
    """Which folders to list for a range.

    Only the year and month folders are opened here, a calendar's worth; those that start after the range are passed over
    unopened. Day folders and folders with other names are left to the readers, whose listing runs on the executors.
    """
    roots = _existing(spark, roots_of(sessions_dir))
    if scan is None:
        return Listing(roots, roots)
    end = scan.end if scan.end.tzinfo else scan.end.replace(tzinfo=UTC)
    paths, opened, skipped = [], 0, 0
    level: list[tuple[str, tuple[str, ...]]] = [(r, ()) for r in roots]
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            opened += len(level)
            below = []
            for (folder, parts), entries in zip(level, pool.map(lambda x: list(_children(spark, x[0])), level), strict=True):
                for path, name, is_folder in entries:
                    if not is_folder:
                        continue
                    date = _date_parts(parts, name)
                    start = None if date is None else _folder_start(date, tz)
                    if start is not None and start > end:
                        skipped += 1
                    elif date is None or len(date) == 3:
                        paths.append(_literal(path))
                    else:
                        below.append((path, date))
                if any(not is_folder and name.endswith(".jsonl") for _, name, is_folder in entries):
                    paths.append(f"{_literal(folder)}/*.jsonl")
            level = below
    return Listing(roots, sorted(paths), opened, skipped)


_FILES = "file_path string, file_name string, mtime timestamp, length bigint, root string, relative string, action string, session_id string"


def list_logs(
    spark: SparkSession, sessions_dir: str, scan: ScanRange | None = None, tz: str = "UTC", listing: Listing | None = None
) -> DataFrame:
    """Files below both roots with their pruning `action`; only the listing is read, no content.

    Folders that start after the range are not listed, so their files don't show.
    """
    listing = listing or plan_listing(spark, sessions_dir, scan, tz)
    if not listing.paths:
        return spark.createDataFrame([], _FILES)
    files = _reader(spark, "binaryFile").load(listing.paths).select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("modificationTime").alias("mtime"),
        "length",
    )
    files = _located(files, listing.roots, F.col("file_path"))
    action = F.lit("read") if scan is None else file_action(
        F.col("file_name"), F.col("relative"), F.col("mtime"), scan, tz
    )
    return files.withColumn("action", action).withColumn(
        "session_id", path_session_id(F.col("file_name"), F.col("file_path"))
    )


# --- lines ------------------------------------------------------------------


def read_lines(
    spark: SparkSession, sessions_dir: str, scan: ScanRange | None = None, tz: str = "UTC", listing: Listing | None = None
) -> DataFrame:
    """Raw lines (file_path, file_name, block, row, value); files outside the range are never opened.

    `block` is the file split a line comes from, `row` orders lines within it.
    """
    from tokentide.sources.manifest import batches

    listing = listing or plan_listing(spark, sessions_dir, scan, tz)
    nothing = spark.createDataFrame([], "file_path string, file_name string, block bigint, row bigint, value string")
    if not listing.paths:
        return nothing
    # Splits must not depend on how many executors happen to be up at a scan.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if scan is None:
        return _raw(_reader(spark, "text").option("lineSep", "\n").load(listing.paths))
    # Files are judged once each, from the listing: a filter on the lines' metadata would judge every line.
    files = stage(list_logs(spark, sessions_dir, scan, tz, listing).select("file_path", "action"), "listed")
    parts = [read_files(spark, paths) for paths in batches(files.where(~F.col("action").startswith("skip")).select("file_path"))]
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines of the named files alone."""
    return _raw(spark.read.option("lineSep", "\n").text([_literal(p) for p in paths]))


def _raw(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def splits(lines: DataFrame) -> DataFrame:
    """Per file split: its first row id, its line count, and the lines before it in the file."""
    counts = lines.groupBy("file_path", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("lines"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    return counts.withColumn("offset", F.coalesce(F.sum("lines").over(before), F.lit(0))).withColumn(
        "file_lines", F.sum("lines").over(whole)
    )


def number_lines(lines: DataFrame, keep: Column | None = None, split_info: DataFrame | None = None) -> DataFrame:
    """Dense 1-based `line_no` within each file.

    Row ids are consecutive within a split, so a line's number follows from its split's
    first id and the line counts of earlier splits: no raw line is sorted or shuffled
    for it, and only lines that pass `keep` meet the small table of splits.
    """
    info = (splits(lines) if split_info is None else split_info).select("file_path", "block", "first_row", "offset")
    wanted = lines if keep is None else lines.where(keep)
    number = F.col("row") - F.col("first_row") + F.col("offset") + 1
    # A line without its split would mean the two scans were cut differently: fail, never lose it.
    lost = F.raise_error(F.lit("file splits changed between scans")).cast("bigint")
    number = F.when(F.col("first_row").isNull(), lost).otherwise(number)
    return wanted.join(info, ["file_path", "block"], "left").withColumn("line_no", number).drop("row", "first_row", "offset")
