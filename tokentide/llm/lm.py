"""Scores of a log-bilinear language model that is trained in numpy with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end per document. All training documents are counted. Every word that occurs `LEAST` times
has vectors of its own, so their number grows with the text. The classes are the most frequent words, groups of the other words with
vectors, the end, and one rest class of all words below `LEAST`, in which a word has its add-0.1 share and one share is left for unseen
words. A context of two tokens predicts the class and then the word inside its group, both through
h = c1 * r[w-1] + c2 * r[w-2] and exp(h . q[w] + b[w]); scores divide by the sum over all classes and by that over the group, so the
model is a distribution over all tokens. Batched matrix products give both sums.

Every task trains one pass over its share of the training text, on all of its positions (`RATE`), from the same start; the
parameters are averaged in each of `TURNS` turns, each vector by its uses in the tasks. What the tasks send grows with their number
times that of the vectors, so there are at most as many tasks as leave each `SEEN` tokens a vector, which keeps it in proportion to
the text. Counts of the words with vectors and of words
above a share of all tokens (at most `MOST_FREQUENT`) are sent to every task; counts of the other words are joined.

Defined cases: a null text is an empty one: one end; a null id counts as held out; without training documents every token's base
probability is 1 (score 0) and the model is uniform over its two classes; repeated rows are scored each; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.words import PIECE_BYTES, Words, pieces
from tokentide.session import stage

# Classes besides the groups: the most frequent words, the end and the rest.
CLASSES = 256
# A word with so many occurrences in the training text has vectors.
LEAST = 10
SIZE = 32
NOISE = 64
BATCH = 256
RATE = 1.0
STEP = 0.15
TURNS = 2
# Gradients are divided by the batch; sums that began far above their squares would make the first steps tiny.
FIRST_SUM = 1e-6
# Training tokens of a task for each word with vectors, on average.
SEEN = 20
ALPHA = 0.1
# A word is sent to all tasks if it makes up at least one part in so many of all training tokens.
MOST_FREQUENT = 250_000
_BLOCK = 1024
_FLUSH = 1 << 21
# Contexts whose products with all classes or a group are in memory at once: so many stay in a core's cache.
_ROWS = 256
# Exponentials of sums below this neither overflow nor vanish in float32.
_SAFE = 60


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    values, at = np.unique(h, return_inverse=True)
    return values, np.bincount(at, weights=c, minlength=len(values)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, held = [], [], 0
    for batch in batches:
        for piece in pieces(batch):
            h, c = np.unique(Words(piece.column("text"), lower=True).hashes(), return_counts=True)
            hashes.append(h)
            counts.append(c)
            held += len(h)
            if held > _FLUSH:
                h, c = _merged(hashes, counts)
                hashes, counts, held = [h], [c], len(h)
                if held > _FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["hash", "n"])
                    hashes, counts, held = [], [], 0
    if hashes:
        h, c = _merged(hashes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["hash", "n"])


@dataclass
class Vocabulary:
    """Counts: `hashes` (sorted) and `counts` of the frequent words, their classes, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    # Counts of the words in groups, most frequent first; their kinds follow the classes, `group_size` of them are a group.
    grouped: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    group_size: int = 1
    _starts: np.ndarray | None = field(default=None, repr=False)
    _most: int = 0

    @property
    def groups(self) -> int:
        return -(-len(self.grouped) // self.group_size)

    def group(self, kind: np.ndarray) -> np.ndarray:
        """Group of each kind, negative if it is a class."""
        return (kind - len(self.class_counts)) // self.group_size

    def top(self, kind: np.ndarray) -> np.ndarray:
        """Class of each kind."""
        return np.where(kind >= len(self.class_counts), self.end - self.groups + self.group(kind), kind)

    def members(self, group: int) -> slice:
        k = len(self.class_counts)
        return slice(k + group * self.group_size, k + min((group + 1) * self.group_size, len(self.grouped)))

    @property
    def end(self) -> int:
        return len(self.class_counts) - 2

    @property
    def rest(self) -> int:
        return len(self.class_counts) - 1

    @property
    def rest_total(self) -> float:
        """Sum of the add-0.1 counts inside the last class, one unseen word among them."""
        known = self.distinct - (self.end - self.groups + len(self.grouped)) - (1 if self.ends else 0)
        return float(self.class_counts[self.rest]) + ALPHA * (known + 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in `hashes`, and whether it is there. Hashes are spread evenly, so their leading bits give the place closely."""
        bits = max(1, len(self.hashes).bit_length())
        if self._starts is None:
            self._starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self._most = int(np.diff(self._starts, append=len(self.hashes)).max())
        at = self._starts[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
        last = len(self.hashes) - 1
        np.minimum(at, last, out=at)
        known = self.hashes[at] == hashes
        for _ in range(1, self._most):
            left = np.flatnonzero(self.hashes[at] < hashes)
            at[left] = np.minimum(at[left] + 1, last)
            known[left] = self.hashes[at[left]] == hashes[left]
        return at, known

    def base(self, counts) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))


def vocabulary(counts: DataFrame, ends: int, classes: int = CLASSES, most: int = MOST_FREQUENT, least: int = LEAST) -> Vocabulary:
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens = words + ends
    sent = counts.where((F.col("n") * most >= tokens) | (F.col("n") >= least))
    frequent = sent.toPandas().sort_values(["n", "hash"], ascending=[False, True])
    h, c = frequent["hash"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    named = min(len(h), classes - 2)
    grouped = c[named:][c[named:] >= least]
    # About half of the tokens are grouped words, so the work is least with twice as many members as groups.
    size = max(16, math.ceil(math.sqrt(2 * len(grouped))))
    sums = np.add.reduceat(grouped, np.arange(0, len(grouped), size)) if len(grouped) else grouped
    totals = np.concatenate([c[:named], sums, [ends, words - c[: named + len(grouped)].sum()]])
    kind = np.full(len(h), len(totals) - 1, np.int32)
    kind[:named] = np.arange(named)
    kind[named : named + len(grouped)] = len(totals) + np.arange(len(grouped))
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], kind[order], totals, tokens, distinct + (1 if ends else 0), ends, grouped, size)


class Sequence:
    """Classes of all tokens of a piece with their two contexts; ends stand between documents."""

    def __init__(self, column: pa.Array, v: Vocabulary):
        self.words = w = Words(column, lower=True)
        self.hashes = w.hashes()
        docs = len(column)
        if len(v.hashes):
            at, self.known = v.find(self.hashes)
            kind = np.where(self.known, v.classes[at], v.rest)
            self.counts = np.where(self.known, v.counts[at], 0)
        else:
            self.known, self.counts = np.zeros(len(self.hashes), bool), np.zeros(len(self.hashes), np.int64)
            kind = np.full(len(self.hashes), v.rest)
        self.place = np.arange(len(self.hashes)) + w.doc
        self.kind = np.full(len(self.hashes) + docs, v.end, np.int32)
        self.kind[self.place] = kind
        self.doc = np.repeat(np.arange(docs), w.count + 1)
        first = w.first[:-1] + np.arange(docs)
        before = np.concatenate([[v.end], self.kind[:-1]])
        before2 = np.concatenate([[v.end, v.end], self.kind[:-2]])[: len(self.kind)]
        start = np.zeros(len(self.kind), bool)
        start[first] = True
        second = np.zeros(len(self.kind), bool)
        second[1:] = start[:-1]
        self.one = np.where(start, v.end, before)
        self.two = np.where(start | second, v.end, before2)


class Model:
    """Parameters; the first `top` rows are the classes (all, if not given), then come the words in groups."""

    def __init__(
        self, log_share: np.ndarray, size: int = SIZE, seed: int = 1, top: int | None = None, packed: list[np.ndarray] | None = None
    ):
        k = len(log_share)
        self.top = k if top is None else top
        self.share = log_share.astype(np.float32)
        self.r = np.empty((k, size), np.float32)
        # Vectors and, in the last column, biases.
        self.qb = np.empty((k, size + 1), np.float32)
        self.q, self.b = self.qb[:, :size], self.qb[:, size]
        if packed is None:
            rng = np.random.default_rng(seed)
            for x, spread in ((self.r, 0.3), (self.q, 0.05)):
                for a in range(0, k, 1 << 15):
                    x[a : a + (1 << 15)] = rng.normal(0, spread, x[a : a + (1 << 15)].shape)
            self.b[...] = log_share
            self.c = np.ones((2, size), np.float32)
        else:
            self.r[...], self.qb[...] = packed[0], packed[1]
            self.b += self.share
            self.c = packed[2].copy()

    def packed(self) -> list[np.ndarray]:
        """Parameters as they are sent: in half precision, biases less the log shares."""
        qb = self.qb.astype(np.float16)
        qb[:, -1] = self.b - self.share
        return [self.r.astype(np.float16), qb, self.c.copy()]

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[one] + self.c[1] * self.r[two]

    def normalisers(self, one: np.ndarray, two: np.ndarray, members: slice | None = None, target: np.ndarray | None = None) -> np.ndarray:
        """Log of the sum over all classes, or over the members of a group, for each context; less the sum of `target`, if given."""
        rows = slice(0, self.top) if members is None else members
        qb = self.qb[rows]
        vectors, bias = qb[:, :-1], qb[:, -1]
        longest, highest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()), np.abs(bias).max()
        ones = np.ones(len(qb), np.float32)
        h = np.ones((_ROWS, qb.shape[1]), np.float32)
        out = np.empty(len(one), np.float32)
        for a in range(0, len(one), _ROWS):
            n = min(_ROWS, len(one) - a)
            x = h[:n, :-1]
            x[...] = self.hidden(one[a : a + n], two[a : a + n])
            s = h[:n] @ qb.T
            # Cauchy and Schwarz: no sum is larger, so in general none needs a shift.
            shift = 0
            if not np.sqrt(np.einsum("ij,ij->i", x, x).max()) * longest + highest < _SAFE:
                shift = s.max(axis=1)
                s -= shift[:, None]
            own = 0 if target is None else s[np.arange(n), target[a : a + n] - rows.start]
            out[a : a + n] = np.log(np.exp(s, out=s) @ ones) - own + (shift if target is None else 0)
        return out


class Training:
    """A model while it is trained by Adagrad. A target's row holds a vector and the bias less what noise-contrastive estimation takes off."""

    def __init__(self, model: Model, noise: int = NOISE):
        self.r, self.q, self.c = model.r, model.qb, model.c
        self.log_noise = np.float32(np.log(noise))
        self.q[:, -1] -= model.share + self.log_noise
        self.r_sums, self.q_sums, self.c_sums = (np.full_like(x, FIRST_SUM) for x in (self.r, self.q, self.c))
        # Place of a row in the batch at hand.
        self._place = np.zeros(len(self.r), np.int64)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """(context vector, target vector, bias less the log share) of some rows, in half precision."""
        found = np.concatenate([self.r[rows], self.q[rows]], axis=1)
        found[:, -1] += self.log_noise
        return found.astype(np.float16)

    def _update(self, table: np.ndarray, sums: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        # One of each row's places stands for it; the gradients of the others are added there.
        at = np.arange(len(rows))
        self._place[rows] = at
        chosen = self._place.take(rows)
        stands = chosen == at
        first, others = stands.nonzero()[0], (~stands).nonzero()[0]
        number = np.empty(len(rows), np.int64)
        number[first] = at[: len(first)]
        width = grad.shape[1]
        g = grad.take(first, axis=0)
        cells = number.take(chosen.take(others))[:, None] * width + np.arange(width)
        np.add.at(g.reshape(-1), cells.reshape(-1), grad.take(others, axis=0).reshape(-1))
        rows = rows.take(first)
        s = sums.take(rows, axis=0)
        s += g * g
        sums[rows] = s
        np.sqrt(s, out=s)
        g /= s
        g *= np.float32(STEP)
        g += table.take(rows, axis=0)
        table[rows] = g

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
        """One step on a batch: true tokens against `noise`, drawn from the classes' shares."""
        n, c = len(target), self.c
        r1, r2, qt, qn = self.r.take(one, axis=0), self.r.take(two, axis=0), self.q.take(target, axis=0), self.q.take(noise, axis=0)
        h = np.ones_like(qt)
        x = h[:, :-1]
        np.multiply(r1, c[0], out=x)
        x += r2 * c[1]
        up = np.einsum("ij,ij->i", h, qt)
        down = h @ qn.T
        # Shares of 1 / (1 + exp(..)): an overflow to infinity gives the zero that is due.
        np.exp(up, out=up)
        up += 1
        np.divide(np.float32(1 / n), up, out=up)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(np.float32(-1 / n), down, out=down)
        share = up[:, None]
        gh = down @ qn[:, :-1]
        gh += share * qt[:, :-1]
        grad = np.empty((n + len(noise), h.shape[1]), np.float32)
        np.multiply(share, h, out=grad[:n])
        np.matmul(down.T, h, out=grad[n:])
        self._update(self.q, self.q_sums, np.concatenate([target, noise]), grad)
        gc = np.stack([np.einsum("ij,ij->j", gh, r1), np.einsum("ij,ij->j", gh, r2)])
        grad = np.empty((2 * n, x.shape[1]), np.float32)
        np.multiply(gh, c[0], out=grad[:n])
        np.multiply(gh, c[1], out=grad[n:])
        self._update(self.r, self.r_sums, np.concatenate([one, two]), grad)
        self.c_sums += gc * gc
        c += np.float32(STEP) * gc / np.sqrt(self.c_sums)


def _log_share(v: Vocabulary) -> np.ndarray:
    """Log shares of the classes, then of the grouped words inside their groups."""
    share = v.class_counts + 1.0
    sums = v.class_counts[v.end - v.groups : v.end]
    inside = v.grouped / np.repeat(sums, v.group_size)[: len(v.grouped)]
    return np.log(np.concatenate([share / share.sum(), inside]))


def _model(v: Vocabulary, parameters: Broadcast | None) -> Model:
    model = Model(_log_share(v), top=len(v.class_counts), packed=parameters and parameters.value)
    if parameters is not None:
        # A worker would hold them beside the model; another task loads them again.
        parameters.__dict__.pop("_value", None)
    return model


def _batches(v: Vocabulary, kind: np.ndarray, chosen: np.ndarray, rng: np.random.Generator):
    """(positions, target rows, noise rows) in random order: every position for its class, grouped words once more inside their group.

    Noise rows are in order.
    """
    k = len(v.class_counts)
    top = v.top(kind[chosen]).astype(np.int64)
    made = [(chosen[a : a + BATCH], top[a : a + BATCH]) for a in range(0, len(chosen), BATCH)]
    outer = len(made)
    inner = chosen[kind[chosen] >= k]
    group = v.group(kind[inner])
    order = np.argsort(group, kind="stable")
    inner, group = inner[order], group[order]
    target = kind[inner].astype(np.int64)
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(inner) else np.zeros(0, np.int64)
    of = []
    for a, b in zip(edges, np.append(edges[1:], len(inner))[: len(edges)], strict=True):
        starts = range(a, b, BATCH)
        made += [(inner[m : min(m + BATCH, b)], target[m : min(m + BATCH, b)]) for m in starts]
        of += [group[a]] * len(starts)
    share = v.class_counts + 1.0
    upper = np.cumsum(share / share.sum())
    noise = np.empty((len(made), NOISE), np.int64)
    noise[:outer] = np.minimum(np.searchsorted(upper, np.sort(rng.random((outer, NOISE)), axis=1), side="right"), k - 1)
    if of:
        lower = np.concatenate([[0], np.cumsum(v.grouped)])
        begin = np.array(of, np.int64)[:, None] * v.group_size
        end = np.minimum(begin + v.group_size, len(v.grouped))
        low, high = lower[begin], lower[end]
        drawn = np.searchsorted(lower, low + np.sort(rng.random((len(of), NOISE)), axis=1) * (high - low), side="right") - 1
        noise[outer:] = k + np.clip(drawn, begin, end - 1)
    for m in rng.permutation(len(made)):
        yield *made[m], noise[m]


def _positions(piece: pa.RecordBatch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Kind and both contexts of every token, and a number for the piece's seed; read in parts, since hashing takes many times a part's bytes."""
    found, first = [], 0
    for part in pieces(piece, most=PIECE_BYTES // 8):
        s = Sequence(part.column("text"), v)
        first = first or int(s.hashes[:1].sum() >> np.uint64(1))
        found.append((s.kind, s.one.astype(np.int64), s.two.astype(np.int64)))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), first


_SUMS = "block int, rows binary, uses binary, vectors binary"


def _trained(v: Vocabulary, start: Broadcast | None, rate: float, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        training = Training(_model(v, start))
        n, top = len(training.r), len(v.class_counts)
        steps, uses = 0, np.zeros((n, 2), np.float32)
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in pieces(batch):
                    kinds, one, two, first = _positions(piece, v)
                    rng = np.random.default_rng([turn, len(kinds), first])
                    chosen = rng.permutation(np.flatnonzero(rng.random(len(kinds)) < rate))
                    noises = []
                    for at, target, noise in _batches(v, kinds, chosen, rng):
                        training.step(one[at], two[at], target, noise)
                        noises.append(noise[np.append(True, noise[1:] != noise[:-1])])
                    kind = kinds[chosen]
                    uses[:, 0] += np.bincount(one[chosen], minlength=n) + np.bincount(two[chosen], minlength=n)
                    for x in (v.top(kind), kind[kind >= top], np.concatenate([*noises, kind[:0]])):
                        uses[:, 1] += np.bincount(x, minlength=n)
                    steps += len(chosen)
        if steps:
            used = np.flatnonzero(uses.any(axis=1)).astype(np.int32)
            edges = np.flatnonzero(np.append(True, used[1:] // _BLOCK != used[:-1] // _BLOCK))
            for rows in np.split(used, edges[1:]):
                yield _sums(rows[0] // _BLOCK, rows, uses[rows], training.vectors(rows))
            yield _sums(-1, np.zeros(1, np.int32), np.array([[steps, 0]], np.float32), training.c.astype(np.float16))

    return run


def _sums(block: int, *arrays: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *columns], names=["block", "rows", "uses", "vectors"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean vectors of each block's rows, by uses: of contexts and of targets."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, *binary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, uses = np.frombuffer(binary[0], np.int32), np.frombuffer(binary[1], np.float32).reshape(-1, 2)
            vectors = np.frombuffer(binary[2], np.float16).reshape(len(rows), -1).astype(np.float32)
            size = 1 if block < 0 else _BLOCK
            total, sums = held.setdefault(block, (np.zeros((size, 2), np.float64), np.zeros((size, vectors.shape[1]), np.float32)))
            total[rows % _BLOCK] += uses
            sums[rows % _BLOCK] += vectors * _weights(uses, block)
    for block, (total, sums) in held.items():
        rows = np.flatnonzero(total.any(axis=1))
        sums = sums[rows] / np.maximum(_weights(total[rows], block), 1e-9)
        yield _sums(block, (rows + max(block, 0) * _BLOCK).astype(np.int32), total[rows].astype(np.float32), sums.astype(np.float16))


def _weights(uses: np.ndarray, block: int) -> np.ndarray:
    return uses[:, :1] if block < 0 else np.repeat(uses, [SIZE, SIZE + 1], axis=1)


def _tasks(v: Vocabulary, cores: int) -> int:
    """Most tasks of a turn: whole rounds on the cores, if there is more than one."""
    tasks = max(1, round(v.tokens / (SEEN * max(1, len(v.grouped)))))
    return tasks - tasks % cores if tasks > cores else tasks


def trained(rows: DataFrame, v: Vocabulary, rate: float = RATE, turns: int = TURNS) -> list[np.ndarray]:
    """Averaged parameters after all turns over the training rows (text)."""
    model = _model(v, None)
    sent: Broadcast | None = None
    rows = rows.select("text").coalesce(_tasks(v, rows.sparkSession.sparkContext.defaultParallelism))
    for turn in range(turns):
        sums = rows.mapInArrow(_trained(v, sent, rate, turn), _SUMS)
        found = sums.repartition("block").mapInArrow(_averaged, _SUMS).toArrow()
        for block, *binary in zip(*(found.column(k) for k in range(4)), strict=True):
            at, uses, vectors = (np.frombuffer(x.as_py(), t) for x, t in zip(binary, (np.int32, np.float32, np.float16), strict=True))
            if block.as_py() < 0:
                model.c[...] = vectors.reshape(model.c.shape)
                continue
            uses, vectors = uses.reshape(-1, 2) > 0, vectors.reshape(len(at), -1)
            context, target = at[uses[:, 0]], at[uses[:, 1]]
            model.r[context] = vectors[uses[:, 0], :SIZE]
            model.qb[target] = vectors[uses[:, 1], SIZE:]
            model.b[target] += model.share[target]
        del found
        if sent is not None:
            sent.destroy()
        if turn + 1 < turns:
            sent = rows.sparkSession.sparkContext.broadcast(model.packed())
    return model.packed()


def _scored(v: Vocabulary, parameters: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(v, parameters)
        for batch in batches:
            for piece in pieces(batch):
                yield _score(piece, v, model)

    return run


def _log_probability(s: Sequence, v: Vocabulary, model: Model) -> np.ndarray:
    """Of each position's class, and of a grouped word inside its group."""
    k = len(model.b)
    pair, at = np.unique(s.one.astype(np.int64) * k + s.two, return_inverse=True)
    out = -model.normalisers(pair // k, pair % k)[at].astype(np.float64)
    top = v.top(s.kind)
    for a in range(0, len(top), 1 << 12):
        part = slice(a, a + (1 << 12))
        of = model.qb[top[part]]
        out[part] += np.einsum("ij,ij->i", model.hidden(s.one[part], s.two[part]), of[:, :-1]) + of[:, -1]
    inner = np.flatnonzero(s.kind >= model.top)
    group = v.group(s.kind[inner])
    order = np.argsort(group, kind="stable")
    inner, group = inner[order], group[order]
    for places in np.split(inner, np.flatnonzero(group[1:] != group[:-1]) + 1) if len(inner) else []:
        kind = s.kind[places]
        out[places] -= model.normalisers(s.one[places], s.two[places], v.members(int(v.group(kind[:1])[0])), kind)
    return out


def _score(piece: pa.RecordBatch, v: Vocabulary, model: Model) -> pa.RecordBatch:
    s = Sequence(piece.column("text"), v)
    docs = len(piece)
    score = _log_probability(s, v, model) / np.log(10)
    base = np.full(len(s.kind), v.base(v.ends))
    base[s.place] = np.where(s.known, v.base(s.counts), 0.0)
    rest = s.known & (s.kind[s.place] == v.rest)
    score[s.place] += np.where(rest, np.log10((s.counts + ALPHA) / v.rest_total), 0.0)
    known = np.full(len(s.kind), v.ends > 0)
    known[s.place] = s.known

    # Words whose counts are not here, by document.
    other = np.flatnonzero(~s.known)
    h, doc = s.hashes[other], s.words.doc[other]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(h)))
    lists = np.searchsorted(doc[begin], np.arange(docs + 1)).astype(np.int32)
    tail = pa.StructArray.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(n.astype(np.int32))], names=["hash", "n"])
    sums = [np.bincount(s.doc, weights=x, minlength=docs) for x in (known, base, score)]
    return pa.RecordBatch.from_arrays(
        [piece.column("rid"), piece.column("doc_id"), piece.column("held_out"), pa.array((s.words.count + 1).astype(np.int64)),
         pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(lists), tail)],
        names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
    )


_SCORED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<hash: long, n: int>>"
)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, turns: int = TURNS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out")
    )
    training = rows.where(~F.col("held_out"))
    counts = stage(training.select("text").mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts, training.count())
    parameters = docs.sparkSession.sparkContext.broadcast(trained(training, v, rate, turns))
    found = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_scored(v, parameters), _SCORED)
    found = stage(found, "scored")
    parameters.destroy()
    c = F.coalesce("c", F.lit(0))
    total, inside = float(v.tokens + ALPHA * (v.distinct + 1)), float(v.rest_total)
    others = (
        found.select("rid", F.explode("tail").alias("t"))
        .select("rid", "t.hash", F.col("t.n").alias("n"))
        .join(counts.select("hash", F.col("n").alias("c")), "hash", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + ALPHA) / total)).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + ALPHA) / inside)).alias("more_score"),
        )
    )
    return found.drop("tail").join(others, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
