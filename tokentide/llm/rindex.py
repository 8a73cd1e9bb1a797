"""A run-length compressed Burrows-Wheeler index of many short strings, with streamed matching statistics.

The strings stand in one text, each closed by a terminator that sorts before all bytes. The transform is kept as
runs of equal symbols. Within a run the last-to-first mapping moves in step, so one base per run is enough; the text places of the
runs' first and last rows are the only samples of the suffix array. Patterns are read from right to left, all at once: where a
pattern's next byte isn't the symbol of its row's run, the pattern continues at the nearest end of a run of that
byte, before or after, whichever sampled place shares the longer string.
"""

from __future__ import annotations

import numpy as np


def _levels(text: np.ndarray, left: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(depth, rank of each suffix by its first `depth` symbols) for growing depths, until all symbols count.

    `left` is the number of symbols before the terminator. A suffix shorter than the depth ends at its terminator.
    """
    base = int(text.max()) + 1
    depth = 1
    while base ** (depth + 1) < 1 << 62 and depth <= longest:
        depth += 1
    key = np.zeros(len(text), np.int64)
    for k in range(depth):
        key *= base
        key[: len(text) - k] += np.where(k < left[: len(text) - k], text[k:], 0)
    place = np.arange(len(text))
    found = []
    while True:
        order = np.argsort(key, kind="stable")
        step = np.ones(len(key), np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(step)
        found.append((depth, rank))
        if depth > longest:
            return found
        key = rank * len(text) + rank[np.minimum(place + depth, place + left)]
        depth *= 2


class RunIndex:
    """Index of byte strings given as one array `data` with n+1 `offsets`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        n = len(data) + len(sizes)
        ends = offsets[1:] + np.arange(len(sizes))
        self.text = np.zeros(n, np.int64)
        solid = np.ones(n, bool)
        solid[ends] = False
        # Symbols are numbered densely; zero ends a string.
        used = np.unique(data)
        code = np.zeros(256, np.int64)
        code[used] = np.arange(1, len(used) + 1)
        self.code = code
        self.text[solid] = code[data]
        self.string = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.left = ends[self.string] - np.arange(n)
        self.levels = _levels(self.text, self.left, int(sizes.max()) if len(sizes) else 0)
        order = np.argsort(self.levels[-1][1], kind="stable")
        self.order = order

        last = self.text[order - 1]
        last[order == 0] = 0
        start = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        self.run_start = start
        self.run_end = np.append(start[1:], n) - 1
        self.run_symbol = last[start]
        # Rows of a symbol before each of its runs, and before the symbol in the first column.
        size = self.run_end - start + 1
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        first_column = np.cumsum(size[by_symbol]) - size[by_symbol]
        self.run_base = np.empty(len(start), np.int64)
        self.run_base[by_symbol] = first_column
        self.first_place, self.last_place = order[self.run_start], order[self.run_end]
        self.symbol_runs = by_symbol
        self.symbol_first = np.searchsorted(self.run_symbol[by_symbol], np.arange(len(used) + 2))
        self.rows = n

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at text places a and b share."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            same = (rank[a] == rank[b]) & (np.minimum(self.left[a], self.left[b]) >= depth)
            total[same] += depth
            a[same] += depth
            b[same] += depth
        # What is left is shorter than the least depth.
        live = np.ones(len(a), bool)
        for _ in range(self.levels[0][0]):
            live &= (self.text[a] == self.text[b]) & (self.left[a] > 0) & (self.left[b] > 0)
            total += live
            a, b = a + live, b + live
        return total

    def stream(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (step, patterns, rows, lengths) from each pattern's last byte on: the longest match from there, and a row with it.

        `patterns` are those that have a byte at this step; `rows` and `lengths` are theirs.
        """
        sizes = np.diff(offsets)
        row = np.arange(len(sizes)) % max(1, np.count_nonzero(self.left == 0))
        place = self.order[row].copy() if self.rows else np.zeros(len(sizes), np.int64)
        length = np.zeros(len(sizes), np.int64)
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = np.flatnonzero(sizes > step)
            symbol = self.code[data[offsets[live + 1] - 1 - step]]
            run = np.searchsorted(self.run_start, row[live], side="right") - 1
            odd = np.flatnonzero((self.run_symbol[run] != symbol) | (symbol == 0))
            if len(odd):
                self._jump(live[odd], symbol[odd], run, odd, row, place, length)
            known = symbol > 0
            at, k = live[known], run[known]
            row[at] = self.run_base[k] + row[at] - self.run_start[k]
            place[at] -= 1
            length[at] += 1
            yield step, live, row[live], length[live]

    def _jump(self, at, symbol, run, odd, row, place, length) -> None:
        """Moves patterns to the nearest run end of their symbol with the longer common string; unknown symbols restart."""
        lo, hi = self.symbol_first[symbol], self.symbol_first[symbol + 1]
        none = (symbol == 0) | (lo == hi)
        length[at[none]] = 0
        row[at[none]] = 0
        place[at[none]] = self.order[0]
        have = np.flatnonzero(~none)
        if not len(have):
            return
        at, lo, hi, odd, symbol = at[have], lo[have], hi[have], odd[have], symbol[have]
        # Runs by (symbol, number): the first one behind the present run.
        key = self.run_symbol[self.symbol_runs] * (len(self.run_start) + 1) + self.symbol_runs
        after = np.searchsorted(key, symbol * (len(self.run_start) + 1) + run[odd])
        nearest = [self.symbol_runs[np.clip(x, lo, hi - 1)] for x in (after - 1, after)]
        shared = []
        for side, k in enumerate(nearest):
            row_at, place_at = (self.run_end[k], self.last_place[k]) if side == 0 else (self.run_start[k], self.first_place[k])
            there = (after - 1 >= lo) if side == 0 else (after < hi)
            shared.append((np.where(there, np.minimum(self.common(place[at], place_at), length[at]), -1), row_at, place_at, k))
        up = shared[0][0] >= shared[1][0]
        for slot, target in ((1, row), (2, place)):
            target[at] = np.where(up, shared[0][slot], shared[1][slot])
        length[at] = np.where(up, shared[0][0], shared[1][0])
        run[odd] = np.where(up, shared[0][3], shared[1][3])

    def groups(self, width: int) -> np.ndarray:
        """For each row, the number of its group of rows that begin with the same `width` symbols (no group is shared by shorter ones)."""
        depth, rank = next((x for x in reversed(self.levels) if x[0] <= width), self.levels[0])
        a, b = self.order[:-1], self.order[1:]
        long = np.minimum(self.left[a], self.left[b]) >= width
        if depth <= width:
            rest = width - depth
            same = long & (rank[a] == rank[b])
            # Depths at least double, so two windows of the depth cover the width or the finer levels do.
            if rest <= depth:
                far = np.flatnonzero(same)
                same[far] = rank[a[far] + rest] == rank[b[far] + rest]
            else:
                far = np.flatnonzero(same)
                same[far] = self.common(a[far], b[far]) >= width
        else:
            same = long.copy()
            far = np.flatnonzero(long)
            same[far] = self.common(a[far], b[far]) >= width
        return np.concatenate([[0], np.cumsum(~same)])
