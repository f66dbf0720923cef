"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` full-dimensional codebooks, trained on residuals. Vectors are
encoded by beam search and stored as codes with the norm of their sum and the cosine between sum and vector. A query's
inner products with all codewords make a lookup table; a candidate's score is the sum of its entries over its stored norm.
The best ``SEED`` of a block by that score give a cosine to beat. The angle between a vector and its sum bounds its cosine
with the query from above; all vectors whose bound reaches the cosine to beat are ranked by the exact cosine, in double
precision, on the original vectors. So the ``k`` nearest are found at any size of the table; codes only save work.

Codebooks are fitted on at most ``SAMPLE`` distinct vectors, those of least hash; every row is encoded and searched.
Equal vectors are one class, searched once, and its smallest ids stand for it, so ties and copies cost nothing and lose
nothing. Query blocks meet code blocks by a shuffle on both block numbers, never by a broadcast, which would bring the
driver a copy of all query vectors for each code block.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without vec_id; repeated rows with one vec_id count once; ties go to the smaller vec_id; with fewer candidates than
``k`` all are returned; an empty table gives an empty result. Columns beside vec_id and embedding are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, written

BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 8
SAMPLE, SEED = 8192, 64
#: Components of a block's vectors, its least rows while cores lack blocks, and the scores held at once.
BLOCK, LEAST_ROWS, SCORES = 1 << 20, 1 << 12, 1 << 18


@dataclass
class Codebooks:
    """``books``: BOOKS x words x d."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> Codebooks:
        """Each book by Lloyd's method on what the books before it leave."""
        rng = np.random.Generator(np.random.PCG64(7))
        words = min(words, len(x))
        left, out = x.astype(np.float32).copy(), []
        for _ in range(books):
            c = left[rng.permutation(len(left))[:words]].copy()
            for _ in range(rounds):
                own = nearest(left, c)
                n = np.bincount(own, minlength=words)
                sums = np.zeros_like(c)
                np.add.at(sums, own, left)
                c[n > 0] = sums[n > 0] / n[n > 0, None]
                if (n == 0).any():
                    c[n == 0] = left[rng.integers(0, len(left), int((n == 0).sum()))]
            left -= c[nearest(left, c)]
            out.append(c)
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norms of their sums; ``beam`` partial sums of each vector are kept at each book."""
        n, books = len(x), len(self.books)
        rest = x.astype(np.float32)[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            width = rest.shape[1]
            cost = (rest**2).sum(-1)[:, :, None] - 2 * rest @ book.T + (book**2).sum(-1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            at = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            src, word = at // len(book), at % len(book)
            rest = np.take_along_axis(rest, src[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, src[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            del width
        best = (rest**2).sum(-1).argmin(1)
        codes = codes[np.arange(n), best]
        total = sum(self.books[m][codes[:, m]] for m in range(books))
        return codes, np.linalg.norm(total, axis=1).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: queries x BOOKS x words."""
        return np.einsum("qd,mwd->qmw", q.astype(np.float32), self.books, optimize=True)

    def aligned(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines of vectors of length 1 with the sums of their codes."""
        total = sum(self.books[m][codes[:, m]].astype(np.float64) for m in range(len(self.books)))
        return ((x * total).sum(1) / np.maximum(np.linalg.norm(total, axis=1), 1e-12)).astype(np.float32)

    def rounding(self) -> float:
        """Bound of the error of a sum of table entries in single precision."""
        return (self.books.shape[2] + len(self.books)) * 2.0**-23 * float(np.linalg.norm(self.books, axis=2).max(1).sum())


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(-1) - 2 * x @ c.T).argmin(1)


def top_by_tables(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places and scores of its best codes."""
    return best_of(by_tables(tables, codes, norms), keep)


def by_tables(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    score = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(tables.shape[1]):
        score += tables[:, m, :][:, codes[:, m]]
    score /= np.maximum(norms, 1e-12)
    return score


def best_of(score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    keep = min(keep, score.shape[1])
    at = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
    return at, np.take_along_axis(score, at, 1)


def nearest_of_block(books: Codebooks, asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, norms: np.ndarray, align: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the ids and exact cosines of the ``k`` rows nearest to it, ties to the smaller id."""
    x, q, d = unit(rows), unit(asked), rows.shape[1]
    slack = np.float32((2 * d + 64) * 2.0**-23)
    off = (books.rounding() / np.maximum(norms, 1e-12)).astype(np.float32) + slack
    away = np.sqrt(np.maximum(0, 1 - align**2) + 2 * off)
    squares = ordered_dot(rows, rows)
    step = min(64, max(1, SCORES // len(x)))
    for at in range(0, len(q), step):
        near = q[at : at + step]
        score = np.clip(by_tables(books.tables(near), codes, norms), -1, 1)
        seeds, _ = best_of(score, max(SEED, k))
        found = np.einsum("qd,qsd->qs", near, x[seeds])
        beat = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.full(len(near), -2, np.float32)
        # cos(a - b) of the angles between query and sum and between sum and vector, widened by what rounding may add.
        bound = score * align + np.sqrt(1 - score**2 + 2 * off) * away + 3 * off
        for i, reached in enumerate(bound >= (beat - slack)[:, None]):
            own = np.flatnonzero(reached)
            close = x[own] @ near[i]
            if len(own) > k:
                own = own[close >= np.partition(close, -k)[-k] - slack]
            who = asked[at + i]
            exact = ordered_dot(rows[own], who) / (np.sqrt(ordered_dot(who[None], who)) * np.sqrt(squares[own]))
            first = np.lexsort((ids[own], -exact))[:k]
            yield at + i, ids[own[first]], exact[first]


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order as ``cosine`` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[..., j].astype(np.float64)
    return out


def taking_part(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that can be compared."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
    # -0.0 and 0.0 are equal components.
    rows = rows.select("vec_id", F.transform(x, lambda v: F.when(v == 0, F.lit(0.0).cast(table.schema["embedding"].dataType.elementType)).otherwise(v)).alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length["n"] if length else 0))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, cls, members): distinct vectors with their k + 1 smallest ids, the first of which names the class."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    part = rows.groupBy("embedding", F.spark_partition_id().alias("p")).agg(least(F.collect_set("vec_id")).alias("members"))
    out = part.groupBy("embedding").agg(least(F.flatten(F.collect_list("members"))).alias("members"))
    return out.select("embedding", F.col("members")[0].alias("cls"), "members")


CODES = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("norms", T.BinaryType()), T.StructField("aligned", T.BinaryType()), T.StructField("rows", T.BinaryType())])
ASKED = T.StructType([T.StructField("asked", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])
FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("score", T.DoubleType())])


def stacked(vectors: pd.Series, kind: str) -> bytes:
    return np.stack(vectors.to_numpy()).astype(kind).tobytes()


def unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = (vectors if isinstance(vectors, np.ndarray) else np.stack(vectors.to_numpy())).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


ENCODED = T.StructType([T.StructField("cls", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("norm", T.FloatType()), T.StructField("align", T.FloatType())])


def encoded(classes: DataFrame, books: Codebooks) -> DataFrame:
    """(cls, code, norm, align, embedding) of every class, wherever its row is."""
    sent = classes.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*ENCODED, classes.schema["embedding"]])

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def drained() -> Iterator[tuple]:
            x = unit(np.array([e for _, e in held]))
            codes, norms = sent.value.encode(x)
            align = sent.value.aligned(x, codes)
            yield from zip([k for k, _ in held], [c.tobytes() for c in codes], norms.tolist(), align.tolist(), [e for _, e in held], strict=True)

        for row in rows:
            held.append(row)
            if len(held) >= 1024:
                yield from drained()
                held.clear()
        if held:
            yield from drained()

    return map_rows(classes, ["cls", "embedding"], make, schema, 1024)


def number_kind(classes: DataFrame) -> str:
    return "<f4" if isinstance(classes.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def code_blocks(classes: DataFrame, books: Codebooks, blocks: int) -> DataFrame:
    """Encoded classes and their vectors, packed by block."""
    kind = number_kind(classes)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        return pd.DataFrame({"block": part["block"].iloc[:1], "ids": [part["cls"].to_numpy(np.int64).tobytes()], "codes": [b"".join(part["code"])], "norms": [part["norm"].to_numpy(np.float32).tobytes()], "aligned": [part["align"].to_numpy(np.float32).tobytes()], "rows": [stacked(part["embedding"], kind)]})

    dealt = encoded(classes, books).withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, CODES)


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    kind = number_kind(queries)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        return pd.DataFrame({"asked": part["asked"].iloc[:1], "ids": [part["cls"].to_numpy(np.int64).tobytes()], "vectors": [stacked(part["embedding"], kind)]})

    return queries.select(F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("asked"), "cls", "embedding").groupBy("asked").applyInPandas(pack, ASKED)


def cells(classes: DataFrame, queries: DataFrame, books: Codebooks) -> DataFrame:
    """Every block of queries with every block of codes, each such pair a row, dealt to tasks.

    The hint keeps Spark from a broadcast, as it takes the copies of all query blocks for the size of one.
    """
    cores, n, width = classes.sparkSession.sparkContext.defaultParallelism, classes.count(), books.books.shape[2]
    blocks = max(1, -(-n * width // BLOCK), min(4 * cores, n // LEAST_ROWS))
    asked = max(1, -(-queries.count() * width // BLOCK))
    tasks = min(blocks * asked, 16 * cores)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    codes = code_blocks(classes, books, blocks).withColumn("asked", every(asked)).repartition(tasks, "block", "asked")
    dealt = query_blocks(queries, asked).select("asked", F.col("ids").alias("q_ids"), "vectors").withColumn("block", every(blocks)).repartition(tasks, "block", "asked")
    return dealt.hint("merge").join(codes, ["block", "asked"])


def candidates(classes: DataFrame, queries: DataFrame, books: Codebooks, k: int) -> DataFrame:
    """(q, cls): for each query class the ``k`` nearest classes; it is itself among them or added later."""
    met = cells(classes, queries, books)
    sent = classes.sparkSession.sparkContext.broadcast(books)
    kind = number_kind(classes)

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        books = sent.value
        d, m = books.books.shape[2], len(books.books)
        for q_ids, vectors, ids, codes, norms, aligned, own in rows:
            q = np.frombuffer(q_ids, np.int64)
            floats = (np.frombuffer(b, np.float32) for b in (norms, aligned))
            block = np.frombuffer(ids, np.int64), np.frombuffer(own, kind).reshape(-1, d), np.frombuffer(codes, np.uint8).reshape(-1, m), *floats
            for who, near, value in nearest_of_block(books, np.frombuffer(vectors, kind).reshape(-1, d), *block, k):
                yield from zip([int(q[who])] * len(near), near.tolist(), value.tolist(), strict=True)

    from pyspark.sql import Window

    found = map_rows(met, ["q_ids", "vectors", "ids", "codes", "norms", "aligned", "rows"], score, FOUND, 8192)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("q", "cls")


def cosine(a: str, b: str) -> F.Column:
    """Exact cosine of two array columns, summed in order in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def least_hashed(classes: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` classes of least hash.

    A sort with a limit brings so many rows of every partition to the driver, or to one task; hashes below a bound, which
    twice as many rows or so pass, leave one task those alone.
    """
    rows = classes.select("embedding", "cls", F.xxhash64("embedding").alias("h"))
    n = classes.count()
    if n > 4 * sample:
        low = rows.where(F.col("h") <= (1 << 64) * 2 * sample // n - (1 << 63))
        if low.count() >= sample:
            rows = low
    return rows.repartition(1).sortWithinPartitions("h", "cls").limit(sample).select("embedding")


def fit(classes: DataFrame, sample: int = SAMPLE) -> Codebooks | None:
    rows = least_hashed(classes, sample).toPandas()
    return Codebooks.fit(unit(rows["embedding"])) if len(rows) else None


def search(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``table`` found for each row of ``queries``, itself left out."""
    from pyspark.sql import Window

    rows = taking_part(table)
    classes = written(classes_of(rows, k))
    books = fit(classes)
    asked = written(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding").distinct())
    # Files of many equal vectors are small, so Spark would broadcast more of them than it means to.
    own = asked.hint("merge").join(classes.select("embedding", "cls"), "embedding").select("query_id", F.col("cls").alias("q"))
    schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return table.sparkSession.createDataFrame([], schema)
    distinct = written(own.select("q").distinct().join(classes.select(F.col("cls").alias("q"), "embedding"), "q").select(F.col("q").alias("cls"), "embedding"))
    near = candidates(classes, distinct, books, k + 1).unionByName(distinct.select(F.col("cls").alias("q"), "cls")).distinct()
    both = near.join(classes.select("cls", F.col("embedding").alias("b"), "members"), "cls").join(distinct.select(F.col("cls").alias("q"), F.col("embedding").alias("a")).hint("merge"), "q")
    scored = both.select("q", "cls", "members", cosine("a", "b").alias("score"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    # Two classes may tie: k + 1 classes and their smallest ids hold the k nearest rows whatever the query's own row is.
    kept = scored.withColumn("r", first).where(F.col("r") <= k + 1)
    spread = own.join(kept, "q").select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
