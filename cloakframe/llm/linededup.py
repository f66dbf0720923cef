"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case, told
apart by a 128-bit hash. ``postings`` (key, document) are the exact table; reference counts are grouped from it, and each
shard of the key space has a cuckoo filter of the keys that are *active*, held by ``min_docs`` documents or more.
Adding and deleting documents changes postings, counts and, by inserting and removing fingerprints, the filters; a
deletion undoes an insertion. A filter only screens: what it lets through is looked up in the exact table. Postings are
dealt to tasks by shard, and those of a shard with many by document too, so that a very common line is spread; each task
gets its shard's filter and its part of the exact table. No filter is held by the driver or sent to all tasks, at any size.

A key's lines stay in the largest doc_id that holds it and go in all others. Defined cases: a null or empty text is one
empty line; keys under ``min_chars`` code points never go; rows that repeat a doc_id count as one document and are
treated alike; rows without doc_id hold no postings and keep all lines; an empty table gives an empty result; columns
beside doc_id and text pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, written

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard on average; the number of shards grows with the table, so that a shard's filter stays small.
SHARD_KEYS = 1 << 17
#: Shards at most, as every task knows each shard's number of tasks (4 bytes); beyond that shards grow: 10^12 active keys make 23 MB each.
MAX_SHARDS = 1 << 20
#: Postings of a shard that one task looks up.
TASK_POSTINGS = 1 << 19
#: Postings that a task gathers before it deals them out.
HELD = 1 << 18

KEY = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
POSTING = T.StructType([T.StructField("doc_id", T.LongType()), *KEY])


def key_of(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def key_hash(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 64 if h >> 127 else 0), (h & (1 << 64) - 1) - (1 << 64 if h >> 63 & 1 else 0)


def hashes_of(text: str | None, min_chars: int = MIN_CHARS) -> list[tuple[int, int] | None]:
    """For each line its key's hash, or None if the key is too short to count."""
    out = []
    for line in (text or "").split("\n"):
        key = key_of(line) if len(line) >= min_chars else ""
        out.append(key_hash(key) if len(key) >= min_chars else None)
    return out


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; keys are pairs of 64-bit hashes. Inserting a key twice holds it twice."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.85))))))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h2.astype(np.int64).view(np.uint64)
        mask = np.uint64(self.buckets - 1)
        print_ = (h & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = h >> np.uint64(20) & mask
        return print_, first, self._other(first, print_)

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (at ^ (print_.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)

    def contains(self, h2: np.ndarray) -> np.ndarray:
        p, a, b = self.places(h2)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, h2: np.ndarray) -> bool:
        """False if some key found no place; the filter is then to be built anew, larger."""
        for p, *ab in zip(*(x.tolist() for x in self.places(h2)), strict=True):
            if not self._put(p, ab):
                return False
        return True

    def _put(self, p: int, ab: list[int]) -> bool:
        for at in ab:
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at = ab[0]
        for kick in range(self.KICKS):
            slot = (p + kick) % self.SLOTS
            p, self.table[at, slot] = int(self.table[at, slot]), p
            at = int(self._other(np.array([at], np.uint64), np.array([p], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        return False

    def remove(self, h2: np.ndarray) -> None:
        """Takes out one fingerprint of each key; keys must have been inserted."""
        for p, *ab in zip(*(x.tolist() for x in self.places(h2)), strict=True):
            for at in ab:
                own = np.flatnonzero(self.table[at] == p)
                if len(own):
                    self.table[at, own[0]] = 0
                    break

    @classmethod
    def of(cls, h2: np.ndarray) -> CuckooFilter:
        size = len(h2)
        while True:
            made = cls.sized(size)
            if made.insert(h2):
                return made
            size = 2 * size + 1


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key) once for each key and row."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            for h in dict.fromkeys(hashes_of(text, min_chars)):
                if h is not None:
                    yield doc_id, *h

    return map_rows(docs.where("doc_id is not null"), ["doc_id", "text"], make, POSTING, 4096)


def reference_counts(posted: DataFrame) -> DataFrame:
    """(h1, h2, refs, last_doc): how many documents hold a key, and the largest of them. Counted before and after the shuffle, so that no key's rows meet in one task."""
    return posted.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))


FILTER = T.StructType([T.StructField("shard", T.LongType()), T.StructField("filter", T.BinaryType())])


def shards_for(keys: int) -> int:
    return min(MAX_SHARDS, max(1, -(-keys // SHARD_KEYS)))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.col("h1"), F.lit(shards))


def build_filters(active: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard of the active keys' space."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h1", "h2"])
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "filter": [CuckooFilter.of(part["h2"].to_numpy()).dump()]})

    return active.select(_shard(shards).alias("shard"), "h1", "h2").groupBy("shard").applyInPandas(build, FILTER)


@dataclass
class LineIndex:
    """What is known of the documents so far. All parts are written tables in the shared folder."""

    posted: DataFrame
    active: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        posted = written(postings(docs, min_chars))
        active = written(reference_counts(posted).where(F.col("refs") >= min_docs))
        shards = shards_for(active.count())
        return cls(posted, active, written(build_filters(active, shards)), shards, min_chars, min_docs)

    def add(self, docs: DataFrame) -> LineIndex:
        """The index with these documents too."""
        new = written(postings(docs, self.min_chars))
        return self._changed(self.posted.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if the documents of these doc_ids had never been added."""
        gone = doc_ids.select("doc_id").where("doc_id is not null").distinct()
        lost = written(self.posted.join(gone, "doc_id", "left_semi"))
        return self._changed(self.posted.join(gone, "doc_id", "left_anti"), lost)

    def _changed(self, posted: DataFrame, touched: DataFrame) -> LineIndex:
        posted = written(posted)
        keys = touched.select("h1", "h2").distinct()
        fresh = written(reference_counts(posted.join(keys, ["h1", "h2"], "left_semi")).where(F.col("refs") >= self.min_docs))
        active = written(self.active.join(keys, ["h1", "h2"], "left_anti").unionByName(fresh))
        before = self.active.join(keys, ["h1", "h2"], "left_semi").select("h1", "h2")
        moves = before.join(fresh, ["h1", "h2"], "left_anti").withColumn("step", F.lit(-1)).unionByName(fresh.select("h1", "h2").join(before, ["h1", "h2"], "left_anti").withColumn("step", F.lit(1)))
        shards = shards_for(active.count())
        if shards > 4 * self.shards:
            filters = build_filters(active, shards)
        else:
            shards, filters = self.shards, self._moved(moves, active)
        return LineIndex(posted, active, written(filters), shards, self.min_chars, self.min_docs)

    def _moved(self, moves: DataFrame, active: DataFrame) -> DataFrame:
        """Filters with fingerprints inserted and removed; a shard that runs full is built anew from the exact table."""

        def move(old: pd.DataFrame, step: pd.DataFrame) -> pd.DataFrame:
            shard = (old if len(old) else step)["shard"].iloc[:1]
            own = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(step))
            own.remove(step.loc[step["step"] < 0, "h2"].to_numpy())
            full = not own.insert(step.loc[step["step"] > 0].sort_values(["h1", "h2"])["h2"].to_numpy())
            return pd.DataFrame({"shard": shard, "filter": [None if full else own.dump()]})

        dealt = moves.select(_shard(self.shards).alias("shard"), "h2", "h1", "step")
        moved = written(self.filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(move, FILTER))
        full = moved.where("filter is null").select("shard")
        again = build_filters(active.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi"), self.shards)
        return moved.where("filter is not null").unionByName(again)

    def screen(self, posted: DataFrame) -> DataFrame:
        """The postings whose line goes from the document: those that the filters let through and whose key is active and held by a later one."""
        sizes = posted.groupBy(_shard(self.shards).alias("shard")).count().join(self.filters.select("shard"), "shard", "left_semi").toArrow()
        tasks = np.zeros(self.shards, np.int32)
        tasks[sizes.column("shard").to_numpy()] = -(-sizes.column("count").to_numpy() // TASK_POSTINGS)
        sent = posted.sparkSession.sparkContext.broadcast(tasks)
        exact = self.active.withColumn("shard", _shard(self.shards)).groupBy("shard").applyInPandas(_packed, "shard long, data binary")
        shared = self.filters.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("data")).unionByName(exact.select("shard", F.lit(1).alias("kind"), "data"))

        def copies(rows: Iterator[tuple]) -> Iterator[tuple]:
            for shard, kind, data in rows:
                yield from ((shard, part, kind, data) for part in range(sent.value[shard]))

        dealt = map_rows(shared, ["shard", "kind", "data"], copies, DEALT, 16).unionByName(posted.select("doc_id", "h1", "h2").mapInArrow(lambda it: _dealt(it, sent.value), DEALT))
        return dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").select("shard", "part", "kind", "data").mapInArrow(_looked_up, POSTING)

    def dropped_keys(self, posted: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines go from a document."""
        return self.screen(posted).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))


#: ``kind``: 0 a filter, 1 a part of the exact table, 2 postings.
DEALT = T.StructType([T.StructField("shard", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["h1", "h2"])
    return pd.DataFrame({"shard": part["shard"].iloc[:1], "data": [part[["h1", "h2", "last_doc"]].to_numpy(np.int64).T.tobytes()]})


def _dealt(batches: Iterator[pa.RecordBatch], tasks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings packed by shard and task; those of shards without active keys stay behind."""

    def drained(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        shard = rows[1] % len(tasks)
        rows, shard = rows[:, tasks[shard] > 0], shard[tasks[shard] > 0]
        part = ((rows[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tasks[shard]
        order = np.lexsort((part, shard))
        rows, shard, part = rows[:, order], shard[order], part[order]
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        begins = np.concatenate([[0], cuts]) if len(shard) else cuts
        for at in range(0, len(begins), 512):
            some = begins[at : at + 512]
            ends = np.append(begins, len(shard))[at + 1 : at + 513]
            data = [rows[:, a:b].tobytes() for a, b in zip(some, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[some], pa.int64()), pa.array(part[some], pa.int32()), pa.array(np.full(len(some), 2), pa.int32()), pa.array(data, pa.binary())], names=DEALT.names)

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(n).to_numpy() for n in ("doc_id", "h1", "h2")]))
        if sum(x.shape[1] for x in held) >= HELD:
            yield from drained(held)
            held = []
    if held:
        yield from drained(held)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one shard after its filter and its part of the exact table: those of active keys with a later document."""
    now, screen, exact = None, None, None
    for batch in batches:
        for shard, part, kind, data in zip(*(batch.column(n).to_pylist() for n in DEALT.names), strict=True):
            if now != (shard, part):
                now, screen, exact = (shard, part), None, None
            if kind == 0:
                screen = CuckooFilter.load(data)
            elif kind == 1:
                exact = np.frombuffer(data, np.int64).reshape(3, -1)
            elif screen is not None and exact is not None:
                rows = np.frombuffer(data, np.int64).reshape(3, -1)
                rows = rows[:, screen.contains(rows[2])]
                last = last_docs(exact, rows[1], rows[2])
                rows = rows[:, rows[0] < last]
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=POSTING.names)


def last_docs(exact: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The largest document of each key in a sorted exact table, the least number for keys that are not there."""
    out = np.full(len(h1), np.iinfo(np.int64).min)
    at, end = np.searchsorted(exact[0], h1, "left"), np.searchsorted(exact[0], h1, "right")
    for step in range(int((end - at).max(initial=0))):
        on = np.flatnonzero(at + step < end)
        on = on[exact[1][at[on] + step] == h2[on]]
        out[on] = exact[2][at[on] + step]
    return out


def drop_lines(docs: DataFrame, index: LineIndex, posted: DataFrame | None = None) -> DataFrame:
    """``docs`` with the text that is left, and what was dropped: columns ``row``, ``kept``, ``n_lines``, ``n_dropped``.

    ``row`` holds the columns of ``docs`` without text.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keys = index.dropped_keys(index.posted if posted is None else posted).withColumnRenamed("doc_id", "__doc")
    whole = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias("__id"), "text")
    joined = whole.join(keys, F.col("__id") == F.col("__doc"), "left").select("row", "text", "keys")
    schema = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    min_chars = index.min_chars

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, text, keys in rows:
            text = text or ""
            if not keys:
                yield row, text, text.count("\n") + 1, 0
                continue
            gone = {(k["h1"], k["h2"]) for k in keys}
            lines = text.split("\n")
            left = [line for line, h in zip(lines, hashes_of(text, min_chars), strict=True) if h not in gone]
            yield row, "\n".join(left), len(lines), len(lines) - len(left)

    return map_rows(joined, ["row", "text", "keys"], make, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Line dedup of a whole table at once, as ``drop_lines`` returns it."""
    return drop_lines(docs, LineIndex.of(docs, min_chars, min_docs))
