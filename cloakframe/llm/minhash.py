"""Circulant MinHash near-duplicates: two permutations sign a set, bands propose, full sets decide.

A set's elements go through one permutation into a universe of ``UNIVERSE`` places (a mixing of their 64-bit hashes);
coordinate k of the signature is the least value that a second permutation, shifted circularly by k, gives them. All shifts
of a place are one run of the permutation's table, so a signature is a minimum over table rows. Bands of coordinates
are buckets. Documents with equal sets are one *class*, named by its smallest doc_id; classes are compared, never
their members. In a bucket each class is checked against one pivot, so candidates grow with the rows and not with
their pairs; classes that are not yet in one component are checked further, until every pair that shares a bucket is
linked, checked, or in one component. Links need the exact similarity of full sets.

Rows are dealt by ranges of (bucket, class) and of (pivot, partner), so that a bucket or a pivot with very many members is
cut over tasks. What is sent to all tasks is bounded: a bitmap of fixed size, which picks the texts to be joined, and the
pivots of buckets that go on from one task to the next, two rows a task at most.

Defined cases: a null text is an empty one; a set without elements is linked with nothing; with fewer words than a
shingle has, the whole sequence is the one element; repeated rows are members of one class; rows of one doc_id are in one
component, also with different texts; rows without doc_id are left out of the search, with a null component, and kept.
Columns beside doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, release, written

BANDS, ROWS = 32, 5
UNIVERSE = 1 << 22
#: Words of 64 bits in the bitmap of wanted ids that is sent to all tasks (at most 4 MB, at any size of the table).
WORDS = 1 << 18
#: Members of one pivot that one task checks.
CHUNK_ROWS = 128
#: Documents for each task that writes a table of buckets, links or components; there are as many tasks as cores at least.
TASK_DOCS = 8192
#: Residual buckets of more classes are checked in blocks of so many.
BLOCK = 256
_PI: list[np.ndarray] = []


def circulant() -> np.ndarray:
    """Row i holds the second permutation at i, i+1, ...: what its shifts give place i."""
    if not _PI:
        k = BANDS * ROWS
        pi = np.random.Generator(np.random.PCG64(20_240_501)).permutation(UNIVERSE).astype(np.uint32)
        _PI.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k))
    return _PI[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(t) for t in tokens], np.uint64)
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def signature(elements: np.ndarray) -> np.ndarray:
    table = circulant()
    places = (mixed(elements + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(out, table[places[at : at + 2048]].min(axis=0), out=out)
    return out


def bands_of(sign: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number for each band."""
    grid = sign.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mixed(h * np.uint64(0x100000001B3) + grid[:, k])
    return h.view(np.int64)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Size, identity and buckets of every document's set."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            own = shingles(text, words)
            whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), ">i8").astype(np.int64)
            yield doc_id, len(own), int(whole[0]), int(whole[1]), bands_of(signature(own)).tolist() if len(own) else []

    return map_rows(docs.where("doc_id is not null"), ["doc_id", "text"], make, SIGNED)


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``v`` may be among ``ids``: all that are and few others, found by a bitmap where they are read."""
    place = F.pmod(F.xxhash64("v"), F.lit(64 * WORDS))
    bits = lambda df: df.withColumn("word", (place / 64).cast("int")).withColumn("bit", F.expr("shiftleft(1L, cast(pmod(xxhash64(v), 64) as int))"))
    bitmap = bits(ids.select("v")).groupBy("word").agg(F.expr("bit_or(bit)").alias("mask"))
    return bits(docs).join(F.broadcast(bitmap), "word").where(F.col("bit").bitwiseAND(F.col("mask")) != 0).drop("word", "bit", "mask")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(v, set) for the documents in ``ids``, and a few others."""
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("set", T.BinaryType())])
    own = marked(docs.select(F.col("doc_id").alias("v"), "text"), ids)
    return map_rows(own, ["v", "text"], lambda rows: ((v, shingles(t, words).tobytes()) for v, t in rows), schema, 128)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
CHUNK = T.StructType([T.StructField("v", T.LongType()), T.StructField("b", T.LongType()), T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType())])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of pivot, cut into parts of ``CHUNK_ROWS`` partners at most; each part begins with its pivot's own row.

    A part is named by its first partner, so parts of a pivot that goes on in another partition differ.
    """
    now, filled, part = None, 0, 0
    for batch in batches:
        a, b = (batch.column(n).to_numpy() for n in ("a", "b"))
        if not len(b):
            continue
        new = np.concatenate([[b[0] != now], b[1:] != b[:-1]])
        place = np.arange(len(b)) - np.maximum.accumulate(np.where(new, np.arange(len(b)), -filled))
        begins = place % CHUNK_ROWS == 0
        first = np.maximum.accumulate(np.where(begins, np.arange(len(b)), -1))
        parts = np.where(first >= 0, a[first], part)
        out = (np.concatenate([b[begins], a]), np.concatenate([b[begins], b]), np.concatenate([parts[begins], parts]), np.concatenate([np.zeros(begins.sum(), np.int32), np.ones(len(a), np.int32)]))
        now, filled, part = b[-1], int(place[-1]) + 1, int(parts[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=CHUNK.names)


def links(docs: DataFrame, pairs: DataFrame, words: int, percent: int, tasks: int | None = None) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, b being a pivot with any number of partners.

    A pivot's partners are cut into parts; each part's task gets the pivot's set and reads the others as a stream.
    """
    dealt = written(pairs.select("a", "b").repartitionByRange("b", "a").sortWithinPartitions("b", "a").mapInArrow(_chunked, CHUNK), tasks)
    rows = sets_of(docs, dealt, words).join(dealt, "v").select("b", "part", "kind", "v", "set")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "kind", "v")

    def check(it: Iterator[tuple]) -> Iterator[tuple]:
        pivot, held = None, []
        for b, part, kind, v, raw in it:
            one = np.frombuffer(raw, np.uint64)
            if pivot != (b, part):
                pivot, held = (b, part), []
            if kind == 0:
                held.append(one)
            elif any(similar(own, one, percent) for own in held):
                yield v, b

    out = written(map_rows(rows, ["b", "part", "kind", "v", "set"], check, LINK), tasks)
    release(dealt)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union|, for sorted distinct values; never for empty sets."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(v, root): the smallest number that can be reached from each end of an edge.

    In each round every vertex goes to its smallest neighbour's place, and from there one place on; then the edges are
    contracted to those between different places, of which soon none are left.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tasks)
    labels = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        parent = written(ends.groupBy("e.v").agg(F.min("e.w").alias("p")), tasks)
        moved = written(parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("root")), "p").select("v", "root"), tasks)
        before = labels
        labels = moved if labels is None else written(labels.join(moved.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left").select("v", F.coalesce("far", "root").alias("root")), tasks)
        at = lambda c: moved.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root"))
        near = edges.join(at("a"), "a").join(at("b"), "b").where("a_root != b_root")
        left = written(near.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), tasks)
        release(edges, parent, before, None if moved is labels else moved)
        edges = left
        if not edges.limit(1).count():
            release(edges)
            return labels


def relabelled(comps: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Components after more edges."""
    back = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    known = edges.join(comps.select(F.col("v").alias("a"), F.col("root").alias("a_root")), "a", "left").join(comps.select(F.col("v").alias("b"), F.col("root").alias("b_root")), "b", "left").select(back("a"), back("b"))
    joined = components(known.where("a != b").distinct(), tasks)
    old = comps.join(joined.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left").select("v", F.coalesce("far", "root").alias("root"))
    new = joined.join(comps.select("v"), "v", "left_anti")
    out = written(old.unionByName(new), tasks)
    release(joined, comps)
    return out


#: A member ``v`` of a bucket with its set's size, and the pivot of its stretch of the bucket; ``edge`` marks the first and the last pivot of a task, whose bucket may go on in another.
RUN = T.StructType([*(T.StructField(n, T.LongType()) for n in ("bucket", "v", "n", "b", "m")), T.StructField("edge", T.BooleanType())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets in order of (bucket, v): all of a bucket that has two here, with its smallest as the pivot."""
    bucket = pivot = size = None
    alone = first = True

    def rows(*columns: np.ndarray, edge: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in columns), pa.array(np.full(len(columns[0]), edge))], names=RUN.names)

    for batch in batches:
        k, v, n = (batch.column(c).to_numpy() for c in ("bucket", "v", "n"))
        if not len(k):
            continue
        if bucket is None:
            yield rows(k[:1], v[:1], n[:1], v[:1], n[:1], edge=True)
        new = np.concatenate([[bucket is None or k[0] != bucket], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        b = np.where(at >= 0, v[at], pivot if pivot is not None else 0)
        m = np.where(at >= 0, n[at], size if size is not None else 0)
        more = np.flatnonzero(~new)
        second = more[np.concatenate([[alone], new[:-1]])[more]]
        yield rows(k[second], b[second], m[second], b[second], m[second])
        yield rows(k[more], v[more], n[more], b[more], m[more])
        first = first and not new[1:].any() and (bucket is None or not new[0])
        bucket, pivot, size = int(k[-1]), int(b[-1]), int(m[-1])
        alone = bool(new[-1])
    if bucket is not None and not first:
        yield rows([bucket], [pivot], [size], [pivot], [size], edge=True)


def members(classes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(bucket, v, n, b, m) of all buckets with two classes or more: each class with the bucket's smallest, its pivot."""
    rows = classes.select("v", "n", F.explode("bands").alias("bucket")).repartitionByRange("bucket", "v").sortWithinPartitions("bucket", "v")
    runs = written(rows.select("bucket", "v", "n").mapInArrow(_runs, RUN), tasks)
    edges = runs.where("edge").select("bucket", "v", "n").distinct()
    least = edges.groupBy("bucket").agg(F.min("v").alias("first"), F.min_by("n", "v").alias("size"), F.count("*").alias("k")).where("k > 1").drop("k")
    # A task gives two edges at most, so these are as few as the tasks.
    own = runs.where("not edge").drop("edge").unionByName(edges.join(least.select("bucket"), "bucket", "left_semi").select("bucket", "v", "n", F.col("v").alias("b"), F.col("n").alias("m")))
    return own.join(F.broadcast(least), "bucket", "left").select("bucket", "v", "n", F.coalesce("first", "b").alias("b"), F.coalesce("size", "m").alias("m"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    docs = docs.select("doc_id", "text")
    sign = written(signed(docs, words))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sign.count() // TASK_DOCS))
    classes = written(sign.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("v"), F.first("n").alias("n"), F.first("bands").alias("bands")), tasks)
    comps = linked(docs, written(members(classes, tasks), tasks), words, percent, tasks)
    named = sign.where("n > 0").select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "v"), ["s1", "s2"])
    # Documents of several texts stand in several classes, which their name joins.
    several = named.groupBy("doc_id").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least != most")
    joins = written(named.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("v").alias("b")).distinct(), tasks)
    if joins.limit(1).count():
        comps = relabelled(comps, joins, tasks)
    roots = sign.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "v"), ["s1", "s2"], "left").withColumn("v", F.coalesce("v", "doc_id"))
    out = roots.join(comps, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "v").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.where("doc_id is null")
    return out.unionByName(map_rows(nameless, ["doc_id", "text"], lambda it: ((k, len(shingles(t, words)), None, True) for k, t in it), out.schema))


def linked(docs: DataFrame, found: DataFrame, words: int, percent: int, tasks: int | None = None) -> DataFrame:
    """Components of the classes in ``found``: (v, root).

    First every class is checked against its pivot in each bucket. Classes that stay outside their pivot's component are
    *apart*; twice they are checked against another member of it. What is still apart then is checked in blocks against
    all of that component and against all that is apart in the same bucket, so that no pair of a bucket is left out.
    """
    sizes = found.select("v", "n").distinct()
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    check = lambda pairs: links(docs, pairs.where(fits).select("a", "b").distinct(), words, percent, tasks)
    pairs = found.where("v != b")
    first = check(pairs.withColumnRenamed("v", "a"))
    comps = components(first, tasks)
    # Where a bucket has but two classes, they have been compared.
    more = pairs.groupBy("bucket").count().where("count > 1").select("bucket")
    missed = pairs.select("bucket", "v", "n", "b").join(first.select(F.col("a").alias("v"), "b"), ["v", "b"], "left_anti").join(more, "bucket", "left_semi")
    apart = written(outside(missed, comps), tasks)
    for turn in (1, 2):
        if not apart.limit(1).count():
            return comps
        other = comps.groupBy("root").agg(F.min_by("v", F.struct(F.xxhash64("v", F.lit(turn)), F.col("v"))).alias("b"))
        tried = apart.select(F.col("v").alias("a"), "n", F.col("big").alias("root")).distinct().join(other, "root").join(sizes.select(F.col("v").alias("b"), F.col("n").alias("m")), "b")
        edges = check(tried)
        if not edges.limit(1).count():
            break
        comps = relabelled(comps, edges, tasks)
        before, apart = apart, written(outside(apart.select("bucket", "v", "n", "b"), comps), tasks)
        release(before, edges)
    return relabelled(comps, blockwise(docs, apart, comps, words, percent, tasks), tasks)


def outside(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, v, n, b, root, big): rows whose class is not in its pivot's component, with both components."""
    at = lambda c, name: comps.select(F.col("v").alias(c), F.col("root").alias(name))
    both = rows.join(at("v", "root"), "v", "left").join(at("b", "big"), "b", "left")
    return both.select("bucket", "v", "n", "b", F.coalesce("root", "v").alias("root"), F.coalesce("big", "b").alias("big")).where("root != big")


def blockwise(docs: DataFrame, apart: DataFrame, comps: DataFrame, words: int, percent: int, tasks: int | None = None) -> DataFrame:
    """Links between apart classes and all members of their pivots' components, and among those apart in one bucket.

    ``way`` 0 is a component, 1 a bucket. Both sides are dealt to blocks of about ``BLOCK`` by hash and every block of one
    meets every block of the other in a task of its own, which holds the sets of one block.
    """
    both = (F.lit(0).alias("way"), F.lit(1).alias("way"))
    held = apart.select(both[0], F.col("big").alias("id"), "v", "root").unionByName(apart.select(both[1], F.col("bucket").alias("id"), "v", "root")).distinct()
    of = comps.join(apart.select(F.col("big").alias("root")).distinct(), "root").select(both[0], F.col("root").alias("id"), "v", "root")
    read = of.unionByName(held.where("way = 1"))
    held, read = written(held, tasks), written(read, tasks)
    count = lambda df, name: df.groupBy("way", "id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    many = written(count(held, "xs").join(count(read, "ys"), ["way", "id"]), tasks)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("v"), c).cast("int")
    wanted = written(
        held.join(many, ["way", "id"]).select("way", "id", "v", "root", place("xs").alias("x"), every("ys").alias("y"), F.lit(0).alias("kind"))
        .unionByName(read.join(many, ["way", "id"]).select("way", "id", "v", "root", every("xs").alias("x"), place("ys").alias("y"), F.lit(1).alias("kind"))),
        tasks,
    )
    rows = sets_of(docs, wanted, words).join(wanted, "v").repartition("way", "id", "x", "y").sortWithinPartitions("way", "id", "x", "y", "kind", "v")

    def check(it: Iterator[tuple]) -> Iterator[tuple]:
        now, block = None, None
        for way, key, x, y, kind, v, root, raw in it:
            if now != (way, key, x, y):
                now, block = (way, key, x, y), Block(percent)
            one = np.frombuffer(raw, np.uint64)
            if kind == 0:
                block.hold(v, root, one)
            else:
                yield from block.links_of(v, root, one)

    out = written(map_rows(rows, ["way", "id", "x", "y", "kind", "v", "root", "set"], check, LINK), tasks)
    release(held, read, many, wanted)
    return out


class Block:
    """Sets held by their elements; gives one link for each two components that meet."""

    def __init__(self, percent: int) -> None:
        self.percent, self.ids, self.roots, self.sets = percent, [], [], []
        self.index = None
        self.parent: dict[int, int] = {}

    def hold(self, v: int, root: int, one: np.ndarray) -> None:
        self.ids.append(v)
        self.roots.append(root)
        self.sets.append(one)

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def links_of(self, v: int, root: int, one: np.ndarray) -> Iterator[tuple[int, int]]:
        if not self.sets:
            return
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], owner[order], sizes
        flat, owner, sizes = self.index
        low, high = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        for k in np.flatnonzero(100 * both >= self.percent * (sizes + len(one) - both)).tolist():
            a, b = self.find(root), self.find(self.roots[k])
            if a != b and both[k]:
                self.parent[max(a, b)] = min(a, b)
                yield v, self.ids[k]
