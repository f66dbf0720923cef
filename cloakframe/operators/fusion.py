"""Scores of several levels fused; spans that overlap resolved; neighbours merged. All inside a row, by array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit
from ..schema import ENTITIES

WEIGHTS = (0.45, 0.30, 0.25)


def fuse_weighted(l1: Column, l2: Column, l3: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Weighted mean of the levels that are present; null if none is."""
    levels = list(zip((l1, l2, l3), weights, strict=True))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in levels), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in levels), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals, 0 if they are apart."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def clusters(items: str, kind: str, iou: float = 0.35) -> str:
    """SQL text: first-fit clusters of items of one type by overlap, in order of start and falling score.

    Clusters that end before the next item begins are closed, so that an item meets only those it may overlap.
    """
    ordered = f"array_sort({items}, (x, y) -> case when x.start <> y.start then x.start - y.start when x.score > y.score then -1 when x.score < y.score then 1 when x.end <> y.end then x.end - y.end when x.entity_type < y.entity_type then -1 when x.entity_type > y.entity_type then 1 else 0 end)"
    near = f"""m -> m.entity_type = e.entity_type and greatest(least(m.end, e.end) - greatest(m.start, e.start), 0)
      >= {iou}D * (greatest(m.end, e.end) - least(m.start, e.start)) and least(m.end, e.end) > greatest(m.start, e.start)"""
    live = "c -> exists(c, m -> m.end > e.start)"
    put = lambda cs: let(f"coalesce(array_position(transform({cs}, c -> exists(c, {near})), true), 0L)", lambda p: f"if({p} = 0, concat({cs}, array(array(e))), transform({cs}, (c, i) -> if(i + 1 = {p}, concat(c, array(e)), c)))")
    step = let(f"filter(a.open, {live})", lambda cs: f"named_struct('open', {put(cs)}, 'done', if(size({cs}) = size(a.open), a.done, concat(a.done, filter(a.open, c -> not exists(c, m -> m.end > e.start)))))")
    return f"aggregate({ordered}, named_struct('open', cast(array() as array<{kind}>), 'done', cast(array() as array<{kind}>)), (a, e) -> {step}, a -> concat(a.done, a.open))"


BEST = "aggregate(slice(c, 2, size(c)), c[0], (b, m) -> if(m.score > b.score, m, b))"


def resolve_overlaps(entities: str, iou: float = 0.35) -> Column:
    """Clusters of one type by overlap, each reduced to its hull with the best member's score and recognizer.

    Overlaps between types are kept.
    """
    hull = f"""transform({clusters(entities, ENTITIES, iou)}, c -> element_at(transform(array({BEST}), b -> named_struct(
      'start', array_min(transform(c, m -> m.start)), 'end', array_max(transform(c, m -> m.end)), 'entity_type', b.entity_type,
      'text', b.text, 'score', array_max(transform(c, m -> m.score)), 'recognizer', b.recognizer)), 1))"""
    return F.expr(f"array_sort({hull})")


CANDIDATE = "struct<start:int,end:int,entity_type:string,score:double,recognizer:string,l1:double,l2:double,l3:double>"


def fused_sql(l1: str, l2: str, l3: str, weights: tuple[float, float, float] = WEIGHTS) -> str:
    """``fuse_weighted`` as SQL text."""
    levels = list(zip((l1, l2, l3), weights, strict=True))
    total = " + ".join(f"coalesce({c} * {w}D, 0D)" for c, w in levels)
    weight = " + ".join(f"if({c} is null, 0D, {w}D)" for c, w in levels)
    return f"least(greatest(({total}) / nullif({weight}, 0D), 0D), 1D)"


def candidates(first: str, second: str | None = None, certain: float = 0.95, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Candidates with a score for each level: entities of level 1 and, in the same order, those with the scores of level 2.

    A certain entity has level 1 alone, and so has every one if level 2 did not run.
    """
    l2 = f"if(a.score >= {certain}D, cast(null as double), b.score)" if second else "cast(null as double)"
    score = f"if(a.score >= {certain}D, a.score, {fused_sql('a.score', 'b.score', 'cast(null as double)', weights)})" if second else "a.score"
    made = f"named_struct('start', a.start, 'end', a.end, 'entity_type', a.entity_type, 'score', {score}, 'recognizer', a.recognizer, 'l1', a.score, 'l2', {l2}, 'l3', cast(null as double))"
    return F.expr(f"zip_with({first}, {second}, (a, b) -> {made})" if second else f"transform({first}, a -> {made})")


def model_candidates(predictions: str, recognizer: str = "ner") -> Column:
    """Candidates of level 3 from a model's predictions; none for null."""
    made = f"named_struct('start', p.start, 'end', p.end, 'entity_type', p.label, 'score', p.score, 'recognizer', {lit(recognizer)}, 'l1', cast(null as double), 'l2', cast(null as double), 'l3', p.score)"
    return F.expr(f"transform(coalesce({predictions}, array()), p -> {made})")


def resolve_levels(items: str, text: str, iou: float = 0.35, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Entities from candidates: clusters of one type by overlap, hulls, and the largest score of each level.

    With a level above the first the score is the weighted mean of the levels, else the best of all; the recognizer is the
    best member's.
    """
    top = lambda k: f"array_max(transform(c, m -> m.{k}))"
    score = f"if({top('l2')} is null and {top('l3')} is null, greatest(coalesce({top('l1')}, 0D), {top('score')}), {fused_sql(top('l1'), top('l2'), top('l3'), weights)})"
    lo, hi = "array_min(transform(c, m -> m.start))", "array_max(transform(c, m -> m.end))"
    hull = f"""transform({clusters(items, f'array<{CANDIDATE}>', iou)}, c -> element_at(transform(array({BEST}), b -> named_struct(
      'start', {lo}, 'end', {hi}, 'entity_type', b.entity_type, 'text', substring({text}, {lo} + 1, {hi} - {lo}), 'score', {score}, 'recognizer', b.recognizer)), 1))"""
    return F.expr(f"array_sort({hull})")


def merge_adjacent(entities: str, text: str, gap: int = 1) -> Column:
    """Neighbours of one type with at most ``gap`` characters between them become one entity."""
    folded = f"""aggregate(array_sort({entities}), cast(array() as {ENTITIES}), (out, e) ->
      if(size(out) > 0 and out[size(out) - 1].entity_type = e.entity_type and e.start <= out[size(out) - 1].end + {gap},
        concat(slice(out, 1, size(out) - 1), array(named_struct('start', out[size(out) - 1].start, 'end', greatest(out[size(out) - 1].end, e.end),
          'entity_type', e.entity_type, 'text', e.text, 'score', greatest(out[size(out) - 1].score, e.score), 'recognizer', out[size(out) - 1].recognizer))),
        concat(out, array(e))))"""
    return F.expr(f"transform({folded}, e -> named_struct('start', e.start, 'end', e.end, 'entity_type', e.entity_type, 'text', substring({text}, e.start + 1, e.end - e.start), 'score', e.score, 'recognizer', e.recognizer))")


def thresholds(entities: str, least: float = 0.5, by_type: dict[str, float] | None = None) -> Column:
    """Entities at or above the threshold of their type."""
    if not by_type:
        return F.filter(entities, lambda e: e["score"] >= least)
    table = F.create_map(*[F.lit(x) for kv in by_type.items() for x in kv])
    return F.filter(entities, lambda e: e["score"] >= F.coalesce(F.element_at(table, e["entity_type"]), F.lit(least)))


def longest_only(entities: str) -> Column:
    """Entities that no longer one overlaps; ties go to the higher score, the earlier start, then the type's name."""
    beats = "o -> o.start < e.end and e.start < o.end and not (o.start = e.start and o.end = e.end and o.entity_type = e.entity_type and o.recognizer = e.recognizer) and struct(o.end - o.start, o.score, -o.start, e.entity_type, e.recognizer) > struct(e.end - e.start, e.score, -e.start, o.entity_type, o.recognizer)"
    return F.expr(f"filter({entities}, e -> not exists({entities}, {beats}))")


def analyze(found: DataFrame, text: str = "text", iou: float = 0.35, threshold: float = 0.5) -> DataFrame:
    """``entities`` resolved, merged and cut at the output threshold, each step in a projection of its own."""
    out = found.withColumn("entities", resolve_overlaps("entities", iou))
    out = out.withColumn("entities", merge_adjacent("entities", f"coalesce({text}, '')"))
    return out.withColumn("entities", thresholds("entities", threshold))


def trace(candidates: str, entities: str, least: float = 0.5) -> Column:
    """For each candidate what became of it: array of (entity_type, start, end, steps), a step being (name, passed, detail)."""
    kept = f"exists({entities}, e -> e.entity_type = c.entity_type and e.start < c.end and c.start < e.end)"
    steps = f"""array(named_struct('name', 'recognizer', 'passed', true, 'detail', c.recognizer),
      named_struct('name', 'threshold', 'passed', c.score >= {least}D, 'detail', cast(c.score as string)),
      named_struct('name', 'output', 'passed', {kept}, 'detail', if({kept}, 'kept or merged', 'dropped')))"""
    return F.expr(f"transform({candidates}, c -> named_struct('entity_type', c.entity_type, 'start', c.start, 'end', c.end, 'steps', {steps}))")


def byte_offsets(entities: str, text: str) -> Column:
    """Start and end of each entity in UTF-8 bytes."""
    return F.expr(f"transform({entities}, e -> named_struct('start', octet_length(left({text}, e.start)), 'end', octet_length(left({text}, e.end))))")
