"""Words, lines and their hashes for many texts at once, as numpy arrays over an Arrow column.

A word is a maximal run of bytes outside the six ASCII white-space characters. Hashes are
64-bit polynomials over random byte values with a final mix, so equal byte strings have equal hashes
in every task and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    steps = np.full(1 << bits, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(base, max(21, int(n).bit_length()))[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, from prefix sums of the polynomial."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    h = (total[end] - total[start]) * powers(_BASE_INVERSE, len(values) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of values[i:i+width] for each i at which a whole window fits."""
    n = max(0, len(values) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(_BASE)
        h += values[k : k + n]
    return mix(h)


def window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Like `window_hash`, from prefix sums: faster for wide windows."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(_BASE_INVERSE, n))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column (null: empty) and the n+1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about `most` bytes of text each, one row at least: working arrays stay small."""
    column = batch.column(name)
    _, off = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a column: byte spans (`start`, `end`), row numbers (`doc`) and the word range of each row (`first`)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offset = buffers(column)
        self.data = LOWER[data] if lower else data
        space = SPACE[data]
        solid = ~space
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offset] = True
        begins = solid.copy()
        begins[1:] &= space[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= space[1:] | edge[1:-1]
        self.solid = solid
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    @property
    def values(self) -> np.ndarray:
        return _VALUES[self.data]

    def hashes(self) -> np.ndarray:
        return span_hash(self.values, self.start, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `width` words and the index of each one's first word."""
        h = window_hash(hashes, width)
        whole = self.doc[: len(h)] == self.doc[width - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        return h[at], at

    def per_row(self, of_bytes: np.ndarray) -> np.ndarray:
        """Sum over each row's bytes of a flag or number per byte."""
        total = np.zeros(len(of_bytes) + 1, np.int64)
        np.cumsum(of_bytes, out=total[1:])
        return total[self.offset[1:]] - total[self.offset[:-1]]

    def per_row_words(self, of_words: np.ndarray) -> np.ndarray:
        """Sum over each row's words of a flag or number per word."""
        total = np.zeros(len(of_words) + 1, np.int64)
        np.cumsum(of_words, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of `width` that starts at one of `at`."""
    change = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + width, n), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the values that occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag
