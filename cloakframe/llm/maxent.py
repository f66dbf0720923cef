"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Each token's probability is that of its class, given the history, times that of the token, given class and history.
Features of the history are the last token, the one before it (a skip feature) and the two together (an n-gram
feature), each hashed to a row of a weight table. The most frequent tokens of the training documents, the head, are in
classes whose members have a softmax of their own over the last token; all other tokens fall into tail classes by their form,
inside which a token's probability goes by its smoothed count. One unseen token per tail class is provided for, so the
probabilities of all outcomes add up to 1.

The model grows with the corpus: ``Shape.of`` sizes classes, head and tables from the number of distinct training tokens.
Classes grow with its fifth root, so 10^5 types have a head of 900 tokens, 10^7 of 5,625 and 10^9 of 35,721, with tables
of 50 million weights, which tasks and the driver still hold; nothing has one size at every input.

Training reduces the whole training text to counts of (history, class) and of (last token, head token), made in every task
before the shuffle; then gradients of the log-likelihood over them are computed in distributed
passes, as many tasks as the counts ask for. Counts are dealt by the last token, so that a task's gradient is sparse; its rows
are summed by table slice on the executors, and the driver gets each slice once. AdaGrad steps go on until the
log-likelihood gains less than ``GAIN`` of itself in a step. Counts of tokens are exact, over all training documents. Scoring
gathers weight rows in sparse numpy batches; counts of rare tokens come from a join.

Defined cases: a null or empty text is the end token alone; rows are scored one by one, so repeated rows get equal
scores; rows without doc_id are scored but not learned from, and are not held out; without training documents N and V
are 0 and the head is empty. Columns beside doc_id and text are left alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, release, training_rows, written

SMOOTH = 0.1
#: Tokens whose counts all tasks hold; a bound on what is broadcast, not on what is counted.
KNOWN = 1 << 17
#: Steps end when one gains less than this share of the log-likelihood, or at MOST_STEPS.
GAIN, MOST_STEPS, RATE, RIDGE = 0.02, 12, 0.5, 0.5
#: Events of a pack, events that one task of a gradient pass reads, rows of a table that one task sums.
PACK_EVENTS, PASS_EVENTS, SLICE_ROWS = 1 << 16, 2_000_000, 4096
#: Training tokens of a part of the events, tokens counted at a time, and events that are merged at a time, at least.
PART_TOKENS, MERGED, MERGED_EVENTS = 2_000_000, 1_500_000, 400_000


@dataclass(frozen=True)
class Shape:
    """Sizes of a model. Ids: head tokens by rank, tail classes, the start."""

    classes: int
    tail: int
    last: int
    skip: int
    both: int
    inner: int

    @classmethod
    def of(cls, types: int) -> Shape:
        """For so many distinct training tokens: classes by the fifth root, rows by the head's size to 0.6, as powers of two."""
        classes = max(8, round(3.0 * types**0.2))
        rows = 1 << max(8, ceil(log2(20 * (classes * classes) ** 0.6)))
        return cls(classes, max(8, classes // 3), rows, rows, 4 * rows, 8 * rows)

    @property
    def width(self) -> int:
        return self.classes

    @property
    def head(self) -> int:
        return self.classes * self.width

    @property
    def all(self) -> int:
        return self.classes + self.tail

    @property
    def start(self) -> int:
        return self.head + self.tail

    @property
    def ids(self) -> int:
        return self.head + self.tail + 1


LN10 = float(np.log(10.0))
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at the six ASCII white spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(token: bytes, tail: int) -> int:
    """By form: digits or signs apart, the others by their last two bytes."""
    if not token.isalpha() and not token[-1:].isalpha() and token[-1:] < b"\x80":
        return 0 if token[:1].isdigit() else 1 if token[:-1].isalpha() else 2
    return 3 + zlib.crc32(token[-2:]) % (tail - 3)


COUNT = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("c", T.LongType())])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over the texts of ``docs``, summed within tasks first; the end token is the empty one."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: Counter = Counter()
        for (text,) in rows:
            held.update(tokens_of(text))
            held[END] += 1
            if len(held) > 300_000:
                yield from held.items()
                held = Counter()
        yield from held.items()

    return map_rows(docs, ["text"], make, COUNT, 1024).groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent tokens in order, their counts, and the totals over all."""

    tokens: list[bytes]
    counts: list[int]
    total: int
    types: int
    shape: Shape

    def ids(self) -> dict[bytes, int]:
        return {t: k for k, t in enumerate(self.tokens)}


@dataclass
class Weights:
    last: np.ndarray
    skip: np.ndarray
    both: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    own: np.ndarray
    shape: Shape

    @classmethod
    def zeros(cls, shape: Shape) -> Weights:
        sizes = [(shape.last, shape.all), (shape.skip, shape.all), (shape.both, shape.all), (shape.inner, shape.width), (1, shape.all), (shape.classes, shape.width)]
        return cls(*(np.zeros(x, np.float32) for x in sizes), shape)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rows_class(shape: Shape, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the class features: last token ``a``, token before it ``b``."""
    both = (_mix(a * np.int64(shape.ids) + b) % np.uint64(shape.both)).astype(np.int64)
    return (_mix(a) % np.uint64(shape.last)).astype(np.int64), (_mix(b) % np.uint64(shape.skip)).astype(np.int64), both


def rows_inner(shape: Shape, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (_mix(a * np.int64(shape.classes) + c) % np.uint64(shape.inner)).astype(np.int64)


def log_sums(rows: Callable[[slice], np.ndarray], n: int) -> np.ndarray:
    """Log of the sum of exponentials of each of ``n`` rows, which are made in stretches."""
    out = np.empty(n)
    for at in range(0, n, 4096):
        z = rows(slice(at, at + 4096))
        top = z.max(axis=1)
        z -= top[:, None]
        out[at : at + 4096] = top + np.log(np.exp(z, out=z).sum(axis=1))
    return out


def class_of(shape: Shape, ids: np.ndarray) -> np.ndarray:
    return np.where(ids < shape.head, ids // shape.width, shape.classes + ids - shape.head)


def score_ids(w: Weights, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of each token's probability; of a tail token, that of its class. A history's softmax is summed up once."""
    shape, own = w.shape, class_of(w.shape, ids)
    x, y, xy = rows_class(shape, a, b)
    _, some, which = np.unique(a * np.int64(shape.ids) + b, return_index=True, return_inverse=True)
    norms = log_sums(lambda s: w.last[x[some[s]]] + w.skip[y[some[s]]] + w.both[xy[some[s]]] + w.bias[0], len(some))
    out = (w.last[x, own] + w.skip[y, own] + w.both[xy, own] + w.bias[0, own]).astype(np.float64) - norms[which]
    head = np.flatnonzero(ids < shape.head)
    if len(head):
        c, place = own[head], ids[head] % shape.width
        row = rows_inner(shape, a[head], c)
        _, some, which = np.unique(a[head] * np.int64(shape.classes) + c, return_index=True, return_inverse=True)
        norms = log_sums(lambda s: w.inner[row[some[s]]] + w.own[c[some[s]]], len(some))
        out[head] += (w.inner[row, place] + w.own[c, place]).astype(np.float64) - norms[which]
    return out


class Reader:
    """Texts as ids: head tokens by rank, the rest by tail class."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.known, self.shape = vocabulary.ids(), vocabulary.shape
        head, tail = self.shape.head, self.shape.tail
        self.tails = np.array([k if k < head else head + tail_class(t, tail) for k, t in enumerate(vocabulary.tokens)] or [0], np.int64)
        self.end = self.known.get(END, -1)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Ranks of the words and the end; -1 marks a word that is not among the known, and those are listed."""
        ranks = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        ranks = np.append(ranks, self.end)
        rare = [words[k] for k in np.flatnonzero(ranks[:-1] < 0).tolist()]
        return ranks, rare

    def ids(self, ranks: np.ndarray, rare: list[bytes]) -> np.ndarray:
        out = self.tails[np.maximum(ranks, 0)]
        gaps = np.flatnonzero(ranks < 0)
        if len(gaps):
            head, tail = self.shape.head, self.shape.tail
            out[gaps] = [head + tail_class(t, tail) for t in rare] + [head + tail_class(END, tail)] * (len(gaps) - len(rare))
        return out


def histories(shape: Shape, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last id and the one before it, of each; a text begins with two starts."""
    padded = np.concatenate([[shape.start, shape.start], ids])
    return padded[1:-1], padded[:-2]


#: Counted events in order of ``k``, packed: 64-bit numbers.
EVENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("k", T.BinaryType()), T.StructField("c", T.BinaryType())])


def training_events(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Counts of all (last, before, class) and (last, head token) of the training texts, by one number each, in packs.

    Packs are dealt by the last token, so that a gradient pass touches few rows of the tables, and merged by part as a stream:
    a task holds what differs, which for one last token is bounded by the model's size, and half of that or ``MERGED_EVENTS`` more.
    """
    sent, shape = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.shape
    parts = max(8, min(shape.ids, -(-vocabulary.total // PART_TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        held: list[np.ndarray] = []
        inner: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                ids = reader.ids(*reader.read(tokens_of(text.as_py())))
                a, b = histories(shape, ids)
                held.append((a * shape.ids + b) * shape.all + class_of(shape, ids))
                head = ids < shape.head
                inner.append(a[head] * shape.head + ids[head])
                size += len(ids)
                if size > MERGED:
                    yield from dealt(held, inner)
                    held, inner, size = [], [], 0
        if held:
            yield from dealt(held, inner)

    def dealt(held: list[np.ndarray], inner: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, own, width in ((0, held, shape.ids * shape.all), (1, inner, shape.head)):
            k = np.concatenate(own)
            own.clear()
            k.sort()
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            k, c = k[first], np.diff(first, append=len(k))
            part = (_mix(k // width) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            for p, some in enumerate(np.split(order, np.searchsorted(part[order], np.arange(1, parts)))):
                if len(some):
                    yield _pack(p, kind, k[some], c[some].astype(np.int64))

    made = docs.select("text").mapInArrow(run, EVENTS)
    return made.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_merged, EVENTS)


def _pack(part: int, kind: int, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=EVENTS.names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one copied at a time: a batch has up to 64 MB."""
    for row in range(batch.num_rows):
        yield tuple(column[row].as_py() for column in batch.columns)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs of a part and kind as one run of events in order, cut into packs again."""

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        k, c = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first)

    def whole(key: tuple[int, int], held: list) -> Iterator[pa.RecordBatch]:
        k, c = summed(held)
        for at in range(0, len(k), PACK_EVENTS):
            yield _pack(*key, k[at : at + PACK_EVENTS], c[at : at + PACK_EVENTS])

    now, held, size, room = None, [], 0, MERGED_EVENTS
    for batch in batches:
        for part, kind, k, c in _rows(batch.select(EVENTS.names)):
            if now != (part, kind):
                if now is not None:
                    yield from whole(now, held)
                now, held, size, room = (part, kind), [], 0, MERGED_EVENTS
            held.append((np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)))
            size += len(held[-1][0])
            if size > room:
                held = [summed(held)]
                size = len(held[0][0])
                room = size + max(MERGED_EVENTS, size // 2)
    if now is not None:
        yield from whole(now, held)


GRADIENT = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("g", T.BinaryType()), T.StructField("loss", T.DoubleType())])
NAMES = ("last", "skip", "both", "inner", "bias", "own")


def gradients(events: DataFrame, w: Weights, passes: int) -> pa.Table:
    """The gradient of the log-likelihood by table slices: every task's sparse rows, summed on the executors."""
    sent = events.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = sent.value, Weights.zeros(sent.value.shape)
        loss = 0.0
        for batch in batches:
            for kind, keys, counts in _rows(batch.select(["kind", "k", "c"])):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64).astype(np.float32)
                for at in range(0, len(k), 16_384):
                    loss += (inner_gradient if kind else class_gradient)(w, g, k[at : at + 16_384], c[at : at + 16_384])
        for t, name in enumerate(NAMES):
            own = getattr(g, name)
            touched = np.flatnonzero(own.any(axis=1))
            for first in range(0, len(own), SLICE_ROWS):
                some = touched[(touched >= first) & (touched < first + SLICE_ROWS)].astype(np.int32)
                if len(some) or (not t and not first):
                    yield _gradient(t, first // SLICE_ROWS, some, own[some], loss if not t and not first else 0.0)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, loss = None, None, 0.0
        for batch in batches:
            for t, part, rows, g, more in _rows(batch.select(GRADIENT.names)):
                at = np.frombuffer(rows, np.int32) - part * SLICE_ROWS
                if now != (t, part):
                    if now is not None:
                        yield _summed(now, held, loss)
                    now, held, loss = (t, part), None, 0.0
                if len(at):
                    own = np.frombuffer(g, np.float32).reshape(len(at), -1)
                    held = np.zeros((SLICE_ROWS, own.shape[1]), np.float32) if held is None else held
                    held[at] += own
                loss += more
        if now is not None:
            yield _summed(now, held, loss)

    parts = events.coalesce(passes).mapInArrow(run, GRADIENT)
    out = parts.repartition("table", "slice").sortWithinPartitions("table", "slice").mapInArrow(total, GRADIENT).toArrow()
    sent.destroy()
    return out


def _gradient(table: int, part: int, rows: np.ndarray, g: np.ndarray, loss: float) -> pa.RecordBatch:
    columns = [pa.array([table], pa.int32()), pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(g).tobytes()], pa.binary()), pa.array([loss])]
    return pa.RecordBatch.from_arrays(columns, names=GRADIENT.names)


def _summed(key: tuple[int, int], held: np.ndarray | None, loss: float) -> pa.RecordBatch:
    if held is None:
        return _gradient(*key, np.zeros(0, np.int32), np.zeros((0, 1), np.float32), loss)
    rows = np.flatnonzero(held.any(axis=1))
    return _gradient(*key, (rows + key[1] * SLICE_ROWS).astype(np.int32), held[rows], loss)


def grouped(k: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories of sorted events, each event's history by number, and where each history's events begin."""
    history = k // width
    new = np.concatenate([[True], history[1:] != history[:-1]])
    return history[new], np.cumsum(new) - 1, np.flatnonzero(new)


def class_gradient(w: Weights, g: Weights, k: np.ndarray, c: np.ndarray) -> float:
    if not len(k):
        return 0.0
    shape = w.shape
    ab, of, first = grouped(k, shape.all)
    x, y, xy = rows_class(shape, ab // shape.ids, ab % shape.ids)
    z = w.last[x] + w.skip[y] + w.both[xy] + w.bias[0]
    return _apply(z, of, first, k % shape.all, c, ((g.last, x), (g.skip, y), (g.both, xy)), g.bias)


def inner_gradient(w: Weights, g: Weights, k: np.ndarray, c: np.ndarray) -> float:
    if not len(k):
        return 0.0
    shape = w.shape
    ac, of, first = grouped(k, shape.width)
    own = ac % shape.classes
    row = rows_inner(shape, ac // shape.classes, own)
    z = w.inner[row] + w.own[own]
    return _apply(z, of, first, k % shape.width, c, ((g.inner, row), (g.own, own)), None)


def _apply(z: np.ndarray, of: np.ndarray, first: np.ndarray, own: np.ndarray, c: np.ndarray, tables: tuple, bias: np.ndarray | None) -> float:
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = float((c * np.log(p[of, own])).sum())
    p *= -np.add.reduceat(c, first)[:, None]
    # Another batch may cut a history in two, but an event comes once.
    p[of, own] += c
    for table, at in tables:
        add_rows(table, at, p)
    if bias is not None:
        bias[0] += p.sum(axis=0)
    return loss


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] += rows``, with equal places summed first."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    table[sorted_at[first]] += np.add.reduceat(rows[order], first, axis=0)


def train(events: DataFrame, vocabulary: Vocabulary, steps: int = MOST_STEPS, gain: float = GAIN) -> tuple[Weights, list[float]]:
    """AdaGrad ascent on the penalised log-likelihood until a step gains too little; the driver holds three copies of the tables."""
    w, seen = Weights.zeros(vocabulary.shape), Weights.zeros(vocabulary.shape)
    _start(w, vocabulary)
    passes = max(1, -(-events.count() * PACK_EVENTS // PASS_EVENTS))
    losses: list[float] = []
    for _ in range(steps):
        loss, total = 0.0, Weights.zeros(vocabulary.shape)
        parts = gradients(events, w, passes)
        for t, rows, g, part in zip(*(parts.column(n) for n in ("table", "rows", "g", "loss")), strict=True):
            loss += part.as_py()
            table = getattr(total, NAMES[t.as_py()])
            at = np.frombuffer(rows.as_buffer(), np.int32)
            table[at] += np.frombuffer(g.as_buffer(), np.float32).reshape(len(at), -1) if len(at) else 0
        del parts
        losses.append(loss)
        if len(losses) > 1 and 0 <= losses[-1] - losses[-2] < gain * abs(losses[-1]):
            break
        for name in NAMES:
            table, square = getattr(w, name), getattr(seen, name)
            g = getattr(total, name) - RIDGE * (table if name not in ("bias", "own") else 0)
            square += g * g
            table += RATE * g / np.sqrt(square + 1e-3)
    return w, losses


def _start(w: Weights, vocabulary: Vocabulary) -> None:
    """Biases begin at the log of the shares of classes and of tokens in them."""
    shape = w.shape
    counts = np.array(vocabulary.counts[: shape.head] + [0] * max(0, shape.head - len(vocabulary.counts)), np.float64) + SMOOTH
    w.own[:] = np.log(counts).reshape(shape.classes, shape.width)
    tail = max(vocabulary.total - sum(vocabulary.counts[: shape.head]), 1) / shape.tail
    w.bias[0] = np.log(np.concatenate([counts.reshape(shape.classes, shape.width).sum(1), np.full(shape.tail, tail)]))
    w.bias -= w.bias.max()


PART = T.StructType(
    [T.StructField("row_no", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("log_p", T.DoubleType()), T.StructField("tail", T.ArrayType(T.LongType())), T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))]
)


def document_parts(docs: DataFrame, vocabulary: Vocabulary, w: Weights) -> DataFrame:
    """A row for each document with what the known tokens give, and a row for each of its rare tokens, still without a count.

    ``row_no`` tells input rows apart. A document's own row has a token that no text can hold, as it begins with a space.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, w))

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        vocabulary, w = sent.value
        reader, shape = Reader(vocabulary), vocabulary.shape
        logs = np.log10(np.array(vocabulary.counts or [0], np.float64) + SMOOTH)
        for some in _texts(rows):
            read = [reader.read(tokens_of(t)) for _, _, t in some]
            ids = [reader.ids(*r) for r in read]
            hist = [histories(shape, i) for i in ids]
            sizes = [len(i) for i in ids]
            log_p = score_ids(w, np.concatenate([a for a, _ in hist]), np.concatenate([b for _, b in hist]), np.concatenate(ids)) / LN10
            at = 0
            for (row, doc_id, _), (ranks, rare), own, n in zip(some, read, ids, sizes, strict=True):
                seen = ranks[ranks >= 0]
                tail = seen[seen >= shape.head]
                p = log_p[at : at + n].sum() + logs[tail].sum()
                at += n
                classes = np.bincount(own[own >= shape.head] - shape.head, minlength=shape.tail).tolist()
                counted = Counter(rare + [END] * (n - len(seen) - len(rare)))
                yield row, doc_id, n, len(seen), float(logs[seen].sum()), float(p), classes, [b" %d" % row, *counted], [0, *counted.values()]

    numbered = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    made = map_rows(numbered, ["row_no", "doc_id", "text"], make, PART, 256)
    each = made.select("*", F.posexplode("rare").alias("pos", "token")).withColumn("own", F.col("pos") == 0)
    zero = lambda c: F.when(F.col("own"), F.col(c)).otherwise(0).alias(c)
    return each.select("token", "row_no", "doc_id", F.element_at("times", F.col("pos") + 1).alias("times"), *[zero(c) for c in ("n_tokens", "n_known", "base", "log_p")], F.when(F.col("own"), F.col("tail")).alias("tail"))


def _texts(rows: Iterator[tuple], chars: int = 500_000) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def tail_masses(counts: DataFrame, vocabulary: Vocabulary) -> list[float]:
    """Smoothed counts of each tail class over all its tokens and one unseen."""
    shape = vocabulary.shape
    head = set(vocabulary.tokens[: shape.head])
    schema = T.StructType([T.StructField("tail", T.IntegerType()), T.StructField("mass", T.DoubleType())])

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = np.zeros(shape.tail)
        for token, c in rows:
            token = bytes(token)
            if token not in head:
                own[tail_class(token, shape.tail)] += c + SMOOTH
        yield from enumerate(own.tolist())

    out = np.full(shape.tail, SMOOTH)
    for r in map_rows(counts, ["token", "c"], make, schema).groupBy("tail").agg(F.sum("mass").alias("mass")).collect():
        out[r["tail"]] += r["mass"]
    return out.tolist()


def score_documents(docs: DataFrame, steps: int = MOST_STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; see the module."""
    docs = docs.select("doc_id", "text")
    learn = docs.where(F.coalesce(training_rows("doc_id", 10), F.lit(False)))
    counts = written(token_counts(learn))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = max(KNOWN, Shape.of(types).head)
    top = counts.orderBy(F.desc("c"), "token").limit(known).toArrow()
    vocabulary = Vocabulary(top.column("token").to_pylist(), top.column("c").to_pylist(), total, types, Shape.of(types))
    events = written(training_events(learn, vocabulary))
    weights, _ = train(events, vocabulary, steps)
    release(events)
    masses = np.log10(tail_masses(counts, vocabulary)).tolist()
    parts = document_parts(docs, vocabulary, weights)
    rare = parts.join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    logs = F.col("times") * F.log10(c + F.lit(SMOOTH))
    lost = F.aggregate(F.zip_with("tail", F.array(*[F.lit(m) for m in masses]), lambda n, m: n * m), F.lit(0.0), lambda a, x: a + x)
    out = rare.groupBy("row_no").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + logs).alias("base"),
        F.sum(F.col("log_p") + logs - F.coalesce(lost, F.lit(0.0))).alias("score"),
    )
    norm = float(np.log10(total + SMOOTH * (types + 1)))
    return out.select("doc_id", F.coalesce(~training_rows("doc_id", 10), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")
