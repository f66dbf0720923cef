"""Search for a dictionary of literals: a trie with failure links, compiled to tables of integers and run over batches of texts.

The dictionary comes from a table's column. Of a large one, literals that no text can hold are dropped first, where they are
read: those with a run of ``GRAM`` characters that stands in no text, told by a bitmap of fixed size over the runs of all texts.
The rest is compiled once, in tables of ``ENTRIES`` entries at most, as many as it takes, and every table is sent to the tasks once. A batch of texts is laid out as rows of ``LANE``
characters, each with the characters before it that a literal may reach back to, and all rows take a step of the automaton
at once, so that a character costs the same whatever the dictionary holds. Of the occurrences found the leftmost are
chosen, of those the longest, and what overlaps them goes.

Defined cases: literals are matched in any ASCII case; null and empty ones are none; of equal ones the smallest id counts; a
null text has no matches; positions count code points; repeated rows are searched each; an empty dictionary gives none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of one table (states times classes of characters), characters of a lane, code points of a batch.
ENTRIES, LANE, BATCH = 1 << 24, 512, 1 << 22
#: Characters of a run that the texts are asked for, bits of the bitmap as a power of 2, characters of a dictionary that is compiled as it is.
GRAM, BITS, SMALL = 8, 25, 1 << 20


@dataclass
class Table:
    """``step[state * classes + class]`` is the next state; ``literal`` the number of the one that ends there, ``shorter`` the next state with one."""

    codes: np.ndarray
    classes: int
    step: np.ndarray
    literal: np.ndarray
    shorter: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    longest: int


def folded(text: np.ndarray) -> np.ndarray:
    """Code points with A-Z in lower case."""
    return np.where((text >= 65) & (text <= 90), text + 32, text)


def compiled(literals: list[tuple[int, str]]) -> Table:
    """The automaton of (id, literal) pairs."""
    words = [folded(np.frombuffer(w.encode("utf-32-le"), np.uint32)) for _, w in literals]
    letters = np.unique(np.concatenate(words))
    classes = len(letters) + 1
    rows: list[dict[int, int]] = [{}]
    literal = [-1]
    for k, w in enumerate(words):
        at = 0
        for c in (np.searchsorted(letters, w) + 1).tolist():
            nxt = rows[at].get(c)
            if nxt is None:
                nxt = rows[at][c] = len(rows)
                rows.append({})
                literal.append(-1)
            at = nxt
        literal[at] = k if literal[at] < 0 or literals[k][0] < literals[literal[at]][0] else literal[at]
    step = np.zeros((len(rows), classes), np.int32)
    fail = np.zeros(len(rows), np.int32)
    shorter = np.zeros(len(rows), np.int32)
    todo = deque([0])
    while todo:
        at = todo.popleft()
        if at:
            step[at] = step[fail[at]]
            f = fail[at]
            shorter[at] = f if literal[f] >= 0 else shorter[f]
        for c, nxt in rows[at].items():
            fail[nxt] = step[fail[at], c] if at else 0
            step[at, c] = nxt
            todo.append(nxt)
    return Table(letters, classes, step.ravel(), np.array(literal, np.int32), shorter, np.array([len(w) for w in words], np.int32), np.array([i for i, _ in literals], np.int64), max(map(len, words)))


def tables(literals: list[tuple[int, str]], entries: int = ENTRIES) -> list[Table]:
    """As few automata as hold all literals, none with more entries than that unless one literal needs them."""
    out, own, letters, chars = [], [], set(), 1
    for pair in sorted(literals, key=lambda x: (x[1].lower(), x[0])):
        more = letters | set(pair[1])
        # What a literal shares with the one before it is in the trie already.
        new = len(pair[1]) - (len(commonprefix([own[-1][1], pair[1]])) if own else 0)
        if own and (chars + new) * (len(more) + 1) > entries:
            out.append(compiled(own))
            own, more, chars, new = [], set(pair[1]), 1, len(pair[1])
        own.append(pair)
        letters, chars = more, chars + new
    return [*out, compiled(own)] if own else out


def occurrences(table: Table, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, literal's place in the table) of all occurrences in folded code points."""
    at = np.searchsorted(table.codes, text)
    at[at == len(table.codes)] = 0
    own = np.where(table.codes[at] == text, at + 1, 0).astype(np.int32)
    back = table.longest - 1
    lanes = -(-len(own) // LANE)
    padded = np.zeros(back + lanes * LANE, np.int32)
    padded[back : back + len(own)] = own
    state = np.zeros(lanes, np.int32)
    first = np.arange(lanes) * LANE
    ends, states = [], []
    speaks = (table.literal >= 0) | (table.shorter > 0)
    for k in range(back + LANE):
        state = table.step[state * table.classes + padded[first + k]]
        if k >= back:
            hit = np.flatnonzero(speaks[state])
            if len(hit):
                ends.append(first[hit] + (k - back))
                states.append(state[hit])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, state = np.concatenate(ends), np.concatenate(states)
    starts, places = [], []
    while len(end):
        named = table.literal[state]
        there = named >= 0
        starts.append(end[there] - table.sizes[named[there]] + 1)
        places.append(named[there])
        state = table.shorter[state]
        end, state = end[state > 0], state[state > 0]
    return np.concatenate(starts), np.concatenate(places).astype(np.int64)


def leftmost_longest(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the occurrences chosen, in order."""
    order = np.lexsort((-size, start))
    s, e = start[order].tolist(), (start + size)[order].tolist()
    kept, until = [], -1
    for k, at in enumerate(s):
        if at >= until:
            kept.append(k)
            until = e[k]
    return order[kept]


def gram_places(text: np.ndarray) -> np.ndarray:
    """The bit of each run of ``GRAM`` folded code points."""
    n = max(0, len(text) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += text[k : k + n]
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def laid_out(texts: list[str | None]) -> np.ndarray:
    """Folded code points of all texts, with one that no text holds behind each."""
    return folded(np.concatenate([x for t in texts for x in (np.frombuffer((t or "").encode("utf-32-le"), np.uint32), _BETWEEN)]))


def grams_of(docs: DataFrame, text: str) -> np.ndarray:
    """A bit for each place of a run that stands in a text; tasks tell 64 at a time, which are joined on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for part in cut(batch, 0):
                seen[gram_places(laid_out(part.column(0).to_pylist()))] = True
        masks = np.packbits(seen).view(np.int64)
        there = np.flatnonzero(masks)
        for at in range(0, len(there), 1 << 16):
            some = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(masks[some])], names=["word", "mask"])

    rows = docs.select(text).mapInArrow(run, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return np.unpackbits(out.view(np.uint8)).astype(bool)


def possible(own: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The rows of ``own`` (w, i) all of whose runs stand in texts: all literals that a text holds, and few others."""
    sent = own.sparkSession.sparkContext.broadcast(np.packbits(grams_of(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            words = batch.column(0).to_pylist()
            kept = [bool(seen[gram_places(folded(np.frombuffer(w.encode("utf-32-le"), np.uint32)))].all()) for w in words]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return own.mapInArrow(run, own.schema)


def cut(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that texts of about ``BATCH`` characters are laid out at once."""
    held = first = 0
    sizes = [len(t or "") for t in batch.column(column).to_pylist()]
    for k, n in enumerate(sizes):
        held += n
        if held >= BATCH or k == len(sizes) - 1:
            yield batch.slice(first, k + 1 - first)
            first, held = k + 1, 0


def find(docs: DataFrame, dictionary: DataFrame, literal: str, literal_id: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", entries: int = ENTRIES) -> DataFrame:
    """(keys, start, end, literal_id) of the leftmost longest occurrences of a dictionary's literals in each text."""
    spark = docs.sparkSession
    lower = F.translate(literal, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = dictionary.where(F.length(literal) > 0).groupBy(lower.alias("w")).agg(F.min(literal_id).alias("i"))
    if (own.agg(F.sum(F.length("w"))).first()[0] or 0) > SMALL:
        own = possible(own, docs, text)
    all_tables = tables([(r["i"], r["w"]) for r in own.collect()], entries)
    sent = spark.sparkContext.broadcast(all_tables)
    names = ["start", "end", "literal_id"]
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("literal_id", T.LongType())])
    n_keys = len(keys)

    def search(part: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = part.column(n_keys).to_pylist()
        sizes = np.array([len(t or "") + 1 for t in texts])
        stops = np.cumsum(sizes)
        whole = laid_out(texts)
        found = [(*occurrences(t, whole), t) for t in sent.value]
        start = np.concatenate([s for s, _, _ in found]) if found else np.zeros(0, np.int64)
        if not len(start):
            return None
        size = np.concatenate([t.sizes[p] for _, p, t in found])
        ids = np.concatenate([t.ids[p] for _, p, t in found])
        kept = leftmost_longest(start, size)
        start, size, ids = start[kept], size[kept], ids[kept]
        row = np.searchsorted(stops, start, side="right")
        at = (start - (stops - sizes)[row]).astype(np.int32)
        cols = [part.column(k).take(pa.array(row)) for k in range(n_keys)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array((at + size).astype(np.int32)), pa.array(ids)], names=[*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, n_keys):
                out = search(part)
                if out is not None:
                    yield out

    return docs.select(*keys, text).mapInArrow(run, schema)


_BETWEEN = np.array([0xFFFFFFFF], np.uint32)
