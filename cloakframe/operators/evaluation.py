"""Detection quality: spans matched to gold, precision and recall, confusion, thresholds, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit, places

SPAN = ["doc_id", "start", "end", "entity_type"]
# Fixed names of one type under another.
ALIASES = {"DATE_TIME": "DATE", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IBAN_CODE": "IBAN", "US_SSN": "SSN", "CRYPTO": "CRYPTO_WALLET", "NRP": "CUSTOM:NRP", "IP": "IP_ADDRESS"}


def mapped(kind: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(kind)), F.col(kind))


def matched(gold: str, predicted: str, least: float = 0.5) -> Column:
    """For each gold span in order the best prediction of its type not yet used, by overlap; array of (gold, prediction), -1 for none.

    ``gold`` and ``predicted`` are arrays of (start, end, entity_type); the fold is greedy, as its definition is.
    """
    iou = "(greatest(least(g.end, p.end) - greatest(g.start, p.start), 0) / cast((g.end - g.start) + (p.end - p.start) - greatest(least(g.end, p.end) - greatest(g.start, p.start), 0) as double))"
    best = f"""array_max(transform(filter(transform({predicted}, (p, j) -> named_struct('j', j, 'v', if(p.entity_type = g.entity_type and not array_contains(a.used, j), {iou}, -1D))), x -> x.v >= {least}D), x -> named_struct('v', x.v, 'k', -x.j)))"""
    return F.expr(f"""aggregate({gold}, named_struct('used', cast(array() as array<int>), 'out', cast(array() as array<int>)), (a, g) -> element_at(transform(array({best}), b ->
      named_struct('used', if(b is null, a.used, concat(a.used, array(cast(-b.k as int)))), 'out', concat(a.out, array(if(b is null, -1, cast(-b.k as int)))))), 1), a -> a.out)""")


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 and f2; 0 where nothing counts."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), rate(2 * p * r, p + r).alias("f1"), rate(5 * p * r, 4 * p + r).alias("f2")]


def by_type(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact spans as sets: per type true and false positives, misses, support and scores."""
    g, p = gold.select(*SPAN).distinct().withColumn("g", F.lit(1)), predicted.select(*SPAN).distinct().withColumn("p", F.lit(1))
    both = g.join(p, SPAN, "full")
    sums = both.groupBy("entity_type").agg(F.sum(F.expr("if(g = 1 and p = 1, 1, 0)")).alias("tp"), F.sum(F.expr("if(g is null, 1, 0)")).alias("fp"), F.sum(F.expr("if(p is null, 1, 0)")).alias("fn"))
    return sums.select("entity_type", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold_type, predicted_type, n) over spans of equal place; O where one side has none."""
    g = gold.select("doc_id", "start", "end", F.col("entity_type").alias("gold_type"))
    p = predicted.select("doc_id", "start", "end", F.col("entity_type").alias("predicted_type"))
    both = g.join(p, ["doc_id", "start", "end"], "full")
    return both.groupBy(F.coalesce("gold_type", F.lit("O")).alias("gold_type"), F.coalesce("predicted_type", F.lit("O")).alias("predicted_type")).agg(F.count("*").alias("n"))


def false_positive_rate(docs: DataFrame, entities: str = "entities") -> DataFrame:
    return docs.agg(F.avg((F.size(entities) > 0).cast("double")).alias("rate"))


def totals(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of micro totals over exact spans: tp, fp, fn, precision, recall, f1, f2."""
    sums = by_type(gold, predicted).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def known_types(kind: str, types: list[str]) -> Column:
    """A type, or MISMATCH for one that is not among ``types``."""
    return F.when(F.col(kind).isin("O", *types), F.col(kind)).otherwise("MISMATCH")


def grouped(entities: str) -> Column:
    """Entities by type, in order of type, each type's in order of start: array of (entity_type, entities)."""
    kinds = f"array_sort(array_distinct(transform({entities}, e -> e.entity_type)))"
    own = f"array_sort(filter({entities}, e -> e.entity_type = k), (x, y) -> case when x.start <> y.start then x.start - y.start else x.end - y.end end)"
    return F.expr(f"transform({kinds}, k -> named_struct('entity_type', k, 'entities', {own}))")


def allocated(text: str, values: str) -> Column:
    """For each value in order its next place in the text that no value before it has taken: array of (value, start, end), -1 for none."""
    step = "struct<value:string,start:int,end:int>"
    free = f"filter(sequence(0, length({text}) - length(v)), p -> substring({text}, p + 1, length(v)) = v and not exists(a, o -> o.start < p + length(v) and p < o.end))"
    first = f"if(length(v) = 0 or length(v) > length({text}) or not contains({text}, v), -1, coalesce(try_element_at({free}, 1), -1))"
    return F.expr(f"aggregate({values}, cast(array() as array<{step}>), (a, v) -> concat(a, transform(array({first}), p -> named_struct('value', v, 'start', p, 'end', if(p < 0, -1, p + length(v))))))")


def without_overlaps(spans: str) -> Column:
    """Spans (start, end, entity_type) in order; of two that overlap the longer one stays, the earlier of equals."""
    kind = "array<struct<start:int,end:int,entity_type:string>>"
    ordered = f"array_sort(filter({spans}, s -> s.start < s.end), (x, y) -> case when x.start <> y.start then x.start - y.start else y.end - x.end end)"
    last = "a[size(a) - 1]"
    step = f"if(size(a) = 0 or s.start >= {last}.end, concat(a, array(s)), if(s.end - s.start > {last}.end - {last}.start, concat(slice(a, 1, size(a) - 1), array(s)), a))"
    return F.expr(f"aggregate(transform({ordered}, s -> named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type)), cast(array() as {kind}), (a, s) -> {step})")


def coverage(text: str, markers: list[str], percent: int = 95) -> Column:
    """How many markers a text holds, as it is or without white space, and whether they are enough: struct (hits, needed, covered)."""
    bare = f"regexp_replace({text}, '\\\\s', '')"
    hits = " + ".join(f"cast(contains({text}, {lit(m)}) or contains({bare}, {lit(m)}) as int)" for m in markers) or "0"
    return F.expr(f"named_struct('hits', {hits}, 'needed', {least_hits(len(markers), percent)}, 'covered', {hits} >= {least_hits(len(markers), percent)})")


def threshold_curve(rows: DataFrame, score: str, steps: int = 10) -> DataFrame:
    """(threshold, kept, ignored) at 0, 1/steps, ..., 1: scores are counted by step first, then the few counts are summed up."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).alias("step")).agg(F.count("*").alias("n"))
    marks = spark.range(steps + 1).select(F.col("id").alias("mark"))
    both = counts.join(F.broadcast(marks))
    return both.groupBy("mark").agg(F.sum(F.when(F.col("step") >= F.col("mark"), F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("step") < F.col("mark"), F.col("n")).otherwise(0)).alias("ignored")).select((F.col("mark") / steps).alias("threshold"), "kept", "ignored")


def least_hits(n: int, percent: int) -> int:
    """Marks that must be found of ``n`` for a coverage of ``percent``: one at least, unless none are asked for."""
    if n <= 0 or percent <= 0:
        return 0
    return n if percent >= 100 else max(1, n - -(-n * (100 - percent) // 100))


def refined(tags: str) -> Column:
    """IOB tags in which an I without its B before it opens a span."""
    return F.expr(f"transform({tags}, (t, i) -> if(t like 'I-%' and (i = 0 or not {tags}[greatest(i - 1, 0)] in (t, concat('B-', substring(t, 3)))), concat('B-', substring(t, 3)), t))")


def tags_to_spans(tags: str) -> Column:
    """array<(start, end, label)> of token numbers; an I without its B is passed over."""
    step = "array<struct<start:int,end:int,label:string>>"
    return F.expr(f"""aggregate(transform({tags}, (t, i) -> named_struct('t', t, 'i', i)), named_struct('open', false, 'out', cast(array() as {step})), (a, x) ->
      if(x.t like 'B-%', named_struct('open', true, 'out', concat(a.out, array(named_struct('start', x.i, 'end', x.i + 1, 'label', substring(x.t, 3))))),
      if(a.open and x.t = concat('I-', a.out[size(a.out) - 1].label), named_struct('open', true, 'out', concat(slice(a.out, 1, size(a.out) - 1), array(named_struct('start', a.out[size(a.out) - 1].start, 'end', x.i + 1, 'label', a.out[size(a.out) - 1].label)))),
      named_struct('open', false, 'out', a.out))), a -> a.out)""")


#: Tokens that look at the same few spans.
BLOCK = 64


def spans_to_tags(tokens: str, spans: str) -> Column:
    """IOB tags of tokens (start, end) for spans (start, end, entity_type) in characters.

    Each block of tokens looks at the spans that reach into it, so that time does not grow as tokens times spans.
    """
    tag = lambda hits: f"if(size({hits}) = 0, 'O', concat(if({hits}[0].start = t.start, 'B-', 'I-'), {hits}[0].entity_type))"
    one = lambda near: f"t -> {let(f'filter({near}, s -> s.start <= t.start and t.end <= s.end)', tag)}"
    block = lambda all_: lambda part: let(f"named_struct('lo', array_min({part}.end), 'hi', array_max({part}.start))", lambda x: let(f"filter({all_}, s -> s.start <= {x}.hi and {x}.lo <= s.end)", lambda near: f"transform({part}, {one(near)})"))
    tags = lambda ts, all_: f"flatten(transform(sequence(0, (size({ts}) - 1) div {BLOCK}), b -> {let(f'slice({ts}, b * {BLOCK} + 1, {BLOCK})', block(all_))}))"
    return F.expr(let(tokens, lambda ts: let(spans, lambda all_: tags(ts, all_))))


def tokens(text: str) -> Column:
    """array<(start, end, m)> of words between white space."""
    return F.expr(tokens_sql(text))


def tokens_sql(text: str) -> str:
    """SQL of ``tokens``."""
    return places(text, r"\S+")


def label(kind: str) -> str:
    """A metric label: lower case, other signs as underscores, ``unknown`` if empty; as SQL text."""
    return f"if(trim({kind}) = '' or {kind} is null, {lit('unknown')}, regexp_replace(lower(trim({kind})), '[^a-z0-9]', '_'))"
