"""A stream that follows growing log files: lines appended to a file arrive once, in order, in the batch in which they end.

The offset of the stream is a length per file. A batch covers the bytes between two lengths, and a line belongs to the batch that holds
its line end; a line begun in an earlier batch is read from its start. A last line without an end waits. `start`, the byte
at which a line begins, orders the lines of a file and names a line for good.

Files are listed and read through Arrow's file systems, so a folder may be local or in a store Arrow knows; executors
must reach it by the same path. The offset has an entry per file. A file that shrinks is taken for a new one and read from its start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tokentide.session import ship_code

SCHEMA = "file_path string, start bigint, value string"
# Bytes read at once, and bytes of small files that one task takes together.
BLOCK = 1 << 20
TASK_BYTES = 64 << 20
ROWS = 10_000


@dataclass
class Growth(InputPartition):
    """Files of one task, each with the lengths at the two ends of the batch."""

    files: list[tuple[str, int, int]]


def _line_start(file, at: int) -> int:
    """Where the line begins that holds the byte at `at`, or would."""
    while at:
        size = min(BLOCK, at)
        file.seek(at - size)
        cut = file.read(size).rfind(b"\n")
        if cut >= 0:
            return at - size + cut + 1
        at -= size
    return 0


def ended_lines(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Start and text of each line whose end lies in the bytes [begin, end)."""
    at = _line_start(file, begin)
    file.seek(at)
    held, left = b"", end - at
    while left:
        block = file.read(min(BLOCK, left))
        if not block:
            return
        left -= len(block)
        *lines, held = (held + block).split(b"\n")
        for line in lines:
            yield at, line
            at += len(line) + 1


class FollowReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.system, self.folder = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True, recursive=True))
        sizes = {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(".jsonl")}
        return {"files": json.dumps(sizes, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Growth]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        parts, held, size = [], [], 0
        for path, length in sorted(after.items()):
            begin = before.get(path, 0)
            if length == begin:
                continue
            held.append((path, begin if begin < length else 0, length))
            size += length - held[-1][1]
            if size >= TASK_BYTES:
                parts.append(Growth(held))
                held, size = [], 0
        return [*parts, Growth(held)] if held else parts

    def read(self, partition: Growth) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.files:
            starts, lines = [], []
            with self.system.open_input_file(path) as file:
                for at, line in ended_lines(file, begin, end):
                    starts.append(at)
                    lines.append(line.decode("utf-8", "replace"))
                    if len(lines) == ROWS:
                        yield _batch(path, starts, lines)
                        starts, lines = [], []
            if lines:
                yield _batch(path, starts, lines)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _batch(path: str, starts: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines)), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], names=["file_path", "start", "value"]
    )


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options["path"])


def follow(spark: SparkSession, root: str) -> DataFrame:
    """Lines (file_path, block, line_no, value) of all logs below `root` as they are completed; `line_no` is the line's first byte."""
    ship_code(spark)
    spark.dataSource.register(FollowSource)
    lines = spark.readStream.format("growing_logs").option("path", root).load()
    return lines.selectExpr("file_path", "0L AS block", "start AS line_no", "value")
