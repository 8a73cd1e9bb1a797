"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes exactly if every neighbouring pair encodes to itself, so the last token
of each prefix is unique and follows from the last tokens of shorter prefixes. The transducer's state is the bytes read since
the last output and their hypotheses; the token put out last is a register that moves may test. Reading a byte finds the last token of the longer prefix; a token is put out as soon as all
hypotheses that can still grow share it, which takes at most a token's length of lookahead. States and moves are made when
first met and kept; past `MOST_STATES` the table is dropped and made anew, which changes no result.

Decoding concatenates the tokens' bytes and follows UTF-8 with a byte automaton, so text leaves the decoder
in whole characters however the stream is cut; a malformed sequence becomes U+FFFD like in Python's replacement mode.

Defined cases: a null text is an empty one with no tokens; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.words import pieces

MOST_STATES = 1 << 18
MOST_WORDS = 1 << 18
BLOCK = 1 << 14


class State:
    """Hypotheses after some bytes that are pending, whatever token was put out before them.

    `ends[k]` is the last token of the pending prefix of length k + 1; `live` has the places at which a token may have begun
    that is still growing, each with its node in the tree of tokens. A move by a byte has the token that the pending bytes
    would complete (or -1) and two targets with their output: for that token being a neighbour of the one put out before, and not.
    """

    __slots__ = ("ends", "live", "moves", "pending")

    def __init__(self, pending: bytes, ends: tuple[int, ...], live: tuple[tuple[int, int], ...]):
        self.pending, self.ends, self.live = pending, ends, live
        self.moves: dict[int, list] = {}


class Transducer:
    """Encoder of single pieces for one table of ranks, in which a token's parts rank before the token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # The tree of tokens: children by node * 256 + byte, and each node's token.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.grows = [True]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.grows[node] = True
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
            self.token_at[node] = i
        self.edges: dict[int, tuple[list[int], list[int]]] = {}
        self.apart: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[bytes, tuple[int, ...]], State] = {}
        self.start = self.states[b"", ()] = State(b"", (), ())

    def forget(self) -> None:
        """Drop all states and what was found out about tokens; small tables left in place would keep their neighbours' memory."""
        self.apart.clear()
        self.edges.clear()
        self._reset()

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`: what its bytes come to without it, lowest rank first."""
        parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
        while len(parts) > 2:
            made = [self.ranks.get(self.tokens[x] + self.tokens[y], token) for x, y in zip(parts, parts[1:], strict=False)]
            least = min(made)
            if least >= token:
                return None
            k = made.index(least)
            parts[k : k + 2] = [least]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edges(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens that stand at the left and at the right edge of `token` as it grows from single bytes."""
        found = self.edges.get(token)
        if found is None:
            parts = self._parts(token)
            left, right = (self._edges(parts[0])[0], self._edges(parts[1])[1]) if parts else ([], [])
            found = self.edges[token] = ([*left, token], [*right, token])
        return found

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens: no merge across comes before one inside."""
        key = a << 32 | b
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > MOST_STATES:
                self.apart.clear()
            found = self.apart[key] = self._stays_apart(self._edges(a)[1], self._edges(b)[0])
        return found

    def _stays_apart(self, left: list[int], right: list[int]) -> bool:
        never = len(self.tokens) + 1
        i = j = 0
        while True:
            inside = left[i + 1] if i + 1 < len(left) else never
            after = right[j + 1] if j + 1 < len(right) else never
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], never)
            if across < inside and across <= after and across != never:
                return False
            if inside == after == never:
                return True
            if inside <= after:
                i += 1
            else:
                j += 1

    def _path(self, ends: tuple[int, ...], at: int) -> list[int]:
        """Prefix lengths from `at` back to zero along last tokens."""
        path = [at]
        while at:
            at -= len(self.tokens[ends[at - 1]])
            path.append(at)
        return path

    def _whole(self, s: State, byte: int) -> list:
        """A new move of `s`, its targets still open: the token that all pending bytes and this one make, if any."""
        at, node = s.live[0] if s.live else (0, 0)
        node = self.child.get(node << 8 | byte) if not at else None
        move = s.moves[byte] = [self.token_at[node] if node is not None else -1, None, None]
        return move

    def _move(self, s: State, byte: int, whole: bool) -> tuple[State, tuple[int, ...]]:
        """Where a byte leads if a token of all pending bytes may stand (`whole`) or may not."""
        n = len(s.ends)
        token, live = -1, []
        for at, node in (*s.live, (n, 0)):
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if token < 0 <= self.token_at[node] and (self.stays_apart(s.ends[at - 1], self.token_at[node]) if at else whole):
                token = self.token_at[node]
            if self.grows[node]:
                live.append((at, node))
        ends = (*s.ends, token)
        common = self._path(ends, n + 1)
        for at, _ in live:
            others = self._path(ends, at)
            common = [x for x in common if x in others]
        cut = common[0]
        out = tuple([ends[k - 1] for k in reversed(common) if k])
        key = ((s.pending + bytes([byte]))[cut:], ends[cut:])
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(*key, tuple([(at - cut, node) for at, node in live]))
        return found, out

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece. A piece that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self._reset()
        out: list[int] = []
        s, last, apart = self.start, -1, self.apart
        for byte in piece:
            move = s.moves.get(byte) or self._whole(s, byte)
            token = move[0]
            if token < 0 or last < 0:
                way = 1
            else:
                known = apart.get(last << 32 | token)
                way = 1 if (self.stays_apart(last, token) if known is None else known) else 2
            step = move[way]
            if step is None:
                step = move[way] = self._move(s, byte, way == 1)
            s = step[0]
            if step[1]:
                out += step[1]
                last = out[-1]
        out += [s.ends[k - 1] for k in reversed(self._path(s.ends, len(s.ends))) if k]
        return out


class Words(dict):
    """Ids of a word with the space before it, by the word."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MOST_WORDS:
            self.clear()
        ids = self.codec.ids
        if self.codec.letters_match and word.isascii() and word.isalpha():
            # One match of the pattern: neither matched nor kept twice.
            found = tuple(ids.transducer.encode(b" " + word.encode()))
        else:
            found = tuple(chain.from_iterable([ids[p] for p in self.codec.find(" " + word)]))
        if len(word) <= 64:
            self[word] = found
        return found


class Pieces(dict):
    """Ids by piece, filled through the transducer; emptied when full."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MOST_WORDS:
            self.clear()
        found = tuple(self.transducer.encode(piece.encode()))
        if len(piece) <= 64:
            self[piece] = found
        return found


def _ranges() -> dict[int, list[tuple[int, int, int]]]:
    """Moves of the UTF-8 automaton as (low, high, next state); state 0 stands between characters (fixed values)."""
    tail = (0x80, 0xBF)
    return {
        0: [(0, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3),
            (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
        1: [(*tail, 0)],
        2: [(0xA0, 0xBF, 1)],
        3: [(*tail, 1)],
        4: [(0x80, 0x9F, 1)],
        5: [(0x90, 0xBF, 3)],
        6: [(*tail, 3)],
        7: [(0x80, 0x8F, 3)],
    }


MOVES = np.full((8, 256), -1, np.int8)
for _state, _spans in _ranges().items():
    for _low, _high, _next in _spans:
        MOVES[_state, _low : _high + 1] = _next
_MOVES = [list(map(int, row)) for row in MOVES]


class Utf8:
    """Incremental decoder: `feed` bytes in any cut, get whole characters; `close` at the end.

    Between two calls it holds the bytes of a character that the automaton has begun and not ended, three at most.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for begin in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if data[begin] & 0xC0 != 0x80:
                state = 0
                for byte in data[begin:]:
                    state = _MOVES[state][byte]
                    if state <= 0:
                        break
                if state > 0:
                    cut = begin
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return "\ufffd" if held else ""


class Codec:
    """Text to ids and back for one vocabulary and one splitting pattern."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, vocabulary.splitlines())}
        self.find = regex.compile(pattern).findall
        self.double = regex.compile(r"[\s\x1c-\x1f] |^ | $").search
        # Whether a space and ASCII letters are one match, however many follow.
        self.letters_match = regex.match(r"(?:'[a-z]+\|)+ \?\\p\{L\}\+\|", pattern) is not None
        self.ids = Pieces(Transducer(ranks))
        self.words = Words(self)
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.names = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        # No match runs from a solid character on into a space, so words split at single spaces are matched alone.
        if self.double(text):
            return list(chain.from_iterable(map(self.ids.__getitem__, self.find(text))))
        head, *words = text.split(" ")
        out = list(chain.from_iterable(map(self.ids.__getitem__, self.find(head))))
        out.extend(chain.from_iterable(map(self.words.__getitem__, words)))
        return out

    def forget(self) -> None:
        """Drop all that was made lazily."""
        self.ids.transducer.forget()
        self.ids.clear()
        self.words.clear()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, character by whole character."""
        machine = Utf8()
        for i in ids:
            yield machine.feed(self.bytes[i])
        yield machine.close()

    def decode(self, ids: list[int]) -> str:
        """Text of ids, streamed in blocks."""
        machine = Utf8()
        parts = [machine.feed(self.decode_bytes(ids[k : k + BLOCK])) for k in range(0, len(ids), BLOCK)]
        return "".join([*parts, machine.close()])


@lru_cache(maxsize=2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def encoded(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids, decoded) of every document; the vocabulary's file content is a parameter of bounded size.

    The lazily made tables go when a task ends: workers are reused, and other operators' arrays need the room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in batches:
            for piece in pieces(batch):
                ids = [tool.encode(t or "") for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([tool.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "text", "ids", "decoded"],
                )
        tool.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip): what `encoded` gives, digested where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in batches:
            for piece in pieces(batch):
                counts, shas, backs, same = [], [], [], []
                for text in piece.column("text").to_pylist():
                    ids = tool.encode(text or "")
                    decoded = tool.decode(ids)
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(" ".join(map(tool.names.__getitem__, ids)).encode()).hexdigest())
                    backs.append(hashlib.sha256(decoded.encode()).hexdigest())
                    same.append(decoded == (text or ""))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string()),
                     pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
