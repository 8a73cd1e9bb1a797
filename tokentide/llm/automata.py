"""Weighted acyclic automata over word numbers: every path of words leads to a state that holds the path's count.

States are numpy arrays, level by level: the state before (`parent`), the word of the arc (an index of the sorted `words`) and the
summed `weight`. Arcs of one state are sorted by word, so a state is found by binary search of (parent, word). States without
arcs need no rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


@dataclass
class Level:
    parent: np.ndarray
    word: np.ndarray
    weight: np.ndarray


class Counts:
    """A count transducer: paths of at most `len(levels)` words and the weight of each path."""

    def __init__(self, words: np.ndarray, levels: list[Level]):
        self.words, self.levels = words, levels

    @classmethod
    def from_sorted(cls, paths: np.ndarray, weights: np.ndarray) -> Counts:
        """From lexicographically sorted paths, a row of positive word numbers each, padded with zeros at its end.

        Every row adds the states behind the prefix that it shares with the row before, and its weight to all states on its path.
        """
        words = np.unique(paths)
        words = words[words > 0]
        total = np.concatenate([[0], np.cumsum(weights)])
        new = np.zeros(len(paths), bool)
        new[:1] = True
        levels, parent = [], np.zeros(len(paths), np.int64)
        for d in range(paths.shape[1]):
            col = paths[:, d]
            new[1:] |= col[1:] != col[:-1]
            there = np.flatnonzero(new & (col > 0))
            # A state's rows end where the next state of its level begins, or a path without this level.
            ends = np.append(np.flatnonzero(new), len(paths))
            stop = ends[np.searchsorted(ends, there, side="right")]
            levels.append(Level(parent[there], np.searchsorted(words, col[there]), total[stop] - total[there]))
            state = np.zeros(len(paths), np.int64)
            state[there] = 1
            parent = np.cumsum(state) - 1
        return cls(words, levels)

    @classmethod
    def union(cls, parts: list[Counts]) -> Counts:
        """The automaton of all paths of `parts`, with the weights of equal paths summed."""
        words = np.unique(np.concatenate([p.words for p in parts]))
        spot = [np.searchsorted(words, p.words) for p in parts]
        merged = [np.zeros(1, np.int64) for _ in parts]
        levels = []
        for d in range(max(len(p.levels) for p in parts)):
            mine = [(k, p.levels[d]) for k, p in enumerate(parts) if d < len(p.levels)]
            key = np.concatenate([merged[k][x.parent] * len(words) + spot[k][x.word] for k, x in mine])
            weight = np.concatenate([x.weight for _, x in mine])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            place = np.zeros(len(key), np.int64)
            place[first] = 1
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(place) - 1
            at = 0
            for k, x in mine:
                merged[k] = number[at : at + len(x.parent)]
                at += len(x.parent)
            summed = np.add.reduceat(weight[order], first) if len(first) else weight[:0]
            size = max(1, len(words))
            levels.append(Level(key[first] // size, key[first] % size, summed))
        return cls(words, levels)

    def compose(self, other: Counts) -> list[np.ndarray]:
        """For the states of each level of `other`: the weight that this automaton gives to the same path, 0 if it has none."""
        spot = np.searchsorted(self.words, other.words)
        known = np.isin(other.words, self.words)
        state, found = np.zeros(1, np.int64), []
        for d, level in enumerate(other.levels):
            before = state[level.parent]
            ok = (before >= 0) & known[level.word]
            state = np.full(len(level.parent), -1, np.int64)
            weight = np.zeros(len(level.parent), np.int64)
            if d < len(self.levels) and len(self.levels[d].parent):
                mine = self.levels[d]
                size = len(self.words)
                key = mine.parent * size + mine.word
                want = before * size + np.where(ok, spot[level.word], 0)
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                ok &= key[at] == want
                state[ok] = at[ok]
                weight[ok] = mine.weight[at[ok]]
            found.append(weight)
        return found

    def paths(self, depth: int) -> np.ndarray:
        """The words of every state of level `depth` (from 1), a row each."""
        out, at = [], np.arange(len(self.levels[depth - 1].parent))
        for level in self.levels[depth - 1 :: -1]:
            out.append(self.words[level.word[at]])
            at = level.parent[at]
        return np.stack(out[::-1], axis=1)

    def to_bytes(self) -> bytes:
        """Compressed; weights and numbers of a level take 4 bytes where they fit."""
        sizes = np.array([len(self.words), *[len(x.parent) for x in self.levels]], np.int64)
        wide = any(len(x.weight) and x.weight.max() >= 1 << 31 for x in self.levels)
        kind = np.int64 if wide else np.int32
        body = [np.diff(self.words, prepend=0).astype(np.int64).tobytes()]
        for x in self.levels:
            body += [np.diff(x.parent, prepend=0).astype(np.int32).tobytes(), x.word.astype(np.int32).tobytes(), x.weight.astype(kind).tobytes()]
        raw = b"".join(body)
        head = np.array([len(self.levels), int(wide), len(raw)], np.int64)
        return head.tobytes() + sizes.tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Counts:
        depth, wide, size = np.frombuffer(data[:24], np.int64).tolist()
        sizes = np.frombuffer(data[24 : 32 + 8 * depth], np.int64)
        raw = pa.decompress(data[32 + 8 * depth :], decompressed_size=size, codec=_CODEC, asbytes=True)
        at = 0

        def take(n: int, kind: type) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out.astype(np.int64)

        words = np.cumsum(take(sizes[0], np.int64))
        kind = np.int64 if wide else np.int32
        levels = [Level(np.cumsum(take(n, np.int32)), take(n, np.int32), take(n, kind)) for n in sizes[1:]]
        return cls(words, levels)
