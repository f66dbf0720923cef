"""Walsh-Hadamard audit of interacting filters: what each removes, in every order, from one pass over the documents.

A document's failures are a mask of one bit a filter. Of each part and label the 32 signed parity sums
sum((-1)^bits(mask & s)), s = 0..31, are aggregated on the way through the corpus; the transform is its own inverse up to a
factor, so that the exact number of documents of each mask comes back from them. All 120 orders are then evaluated on 32
cells a part, and a filter's Shapley value is closed: a document that fails f filters is removed by each of them in 120/f
of the orders.

Whether a text is a copy cannot be told from its row. All rows first count as copies; for each distinct text the rows of
its smallest doc_id are then added once with, and once against, that bit: sums of signs are linear. So no row joins the
group of its copies, however large that is.

Defined cases: a null text is an empty one, and both are copies of each other; a row without doc_id is no copy and has no
label, and no row is its copy; rows of one doc_id and one text are counted each, and none is a copy of another; repeated
label rows count as one that is 1 where any is; a null lang is the part ''. An empty table gives no rows. Other columns of
the input are left alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
ORDERS = len(list(permutations(FILTERS)))


def text_mask(text: str) -> Column:
    """Bits of the filters that a text alone decides: few words, repeated words, capitals, signs."""
    t = F.expr(f"coalesce({text}, '')")
    words = F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda fails, k: F.when(fails, 1 << k).otherwise(0)
    of = lambda w: bit(F.size(w) < 200, 0) + bit(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 1)
    return (F.transform(F.array(words), of)[0] + bit(100 * capitals > 3 * F.length(t), 2) + bit(t.rlike("[#$%&*|]"), 3)).cast("int")


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, label, mask (without the copies' bit), key of the text and the number of such rows; texts are read once."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask("text").alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    rows = rows.groupBy("doc_id", "part", "mask", "key").agg(F.count("*").alias("n"))
    good, toxic = F.max((F.col("quality") == 1).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(good, F.lit(0)) + 2 * F.coalesce(toxic, F.lit(0))).alias("label"))
    return rows.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def signed(mask: Column, n: Column, s: int) -> Column:
    return F.sum(n * (1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(s))) % 2))).cast("long")


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, label and the array of signed parity sums; ``rows`` are facts of one pass, written, since they are read twice."""
    dated = rows.where("doc_id is not null")
    first = dated.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    first = dated.join(first, ["key", "doc_id"], "left_semi")
    flip = first.select("part", "label", F.explode(F.array(F.struct(F.col("mask"), F.col("n")), F.struct((F.col("mask") + COPY).alias("mask"), (-F.col("n")).alias("n")))).alias("x")).select("part", "label", "x.*")
    every = rows.select("part", "label", (F.col("mask") + F.when(F.col("doc_id").isNull(), 0).otherwise(COPY)).alias("mask"), "n")
    sums = every.unionByName(flip).groupBy("part", "label").agg(*(signed(F.col("mask"), F.col("n"), s).alias(f"s{s}") for s in range(MASKS)))
    return sums.select("part", "label", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part and arrays of 32 counts by mask: of all documents, of good and of toxic ones."""
    sign = lambda a, b: f"(1 - 2 * (bit_count({a} & {b}) % 2))"
    inverse = f"transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L, (a, s) -> a + sums[s] * {sign('m', 's')}) div {MASKS})"
    found = sums.select("part", "label", F.expr(inverse).alias("cell"))
    per = lambda name, keep: F.array(*(F.sum(F.when(keep, F.col("cell")[m]).otherwise(0)) for m in range(MASKS))).alias(name)
    return found.groupBy("part").agg(per("docs", F.lit(True)), per("good", F.col("label").bitwiseAND(1) == 1), per("toxic", F.col("label").bitwiseAND(2) == 2))


def orders(table: DataFrame) -> DataFrame:
    """One row for each part, order and step, from cells alone."""
    steps = [(i, k, f) for i, order in enumerate(permutations(FILTERS)) for k, f in enumerate(order)]
    names = ["".join(o) for o in permutations(FILTERS)]
    literal = ", ".join(f"named_struct('o', {i}, 'step', {k + 1}, 'f', {1 << FILTERS.index(f)}, 'before', {sum(1 << FILTERS.index(x) for x in names[i][:k])})" for i, k, f in steps)
    rows = table.select("*", F.explode(F.expr(f"array({literal})")).alias("x"))
    count = lambda cell, when: F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> a + if({when}, {cell}[m], 0L))")
    gone = "m & x.f <> 0 and m & x.before = 0"
    return rows.select(
        "part",
        F.expr(f"element_at(array({', '.join(repr(n) for n in names)}), x.o + 1)").alias("filter_order"),
        F.col("x.step").cast("int").alias("step"),
        count("docs", "m & (x.f | x.before) = 0").alias("kept"),
        count("docs", gone).alias("removed"),
        count("docs", "m & x.f <> 0 and m & x.before <> 0").alias("redundant"),
        F.expr("docs[x.f]").alias("unique_fails"),
        count("good", gone).alias("good_lost"),
        count("toxic", gone).alias("toxic_lost"),
        F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> a + if(m & x.f <> 0, docs[m] * {ORDERS} div bit_count(m), 0L))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E, in all orders, for each part (lang)."""
    return orders(cells(parity_sums(written(facts(docs, labels)))))
