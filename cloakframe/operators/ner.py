"""Level 3: token predictions merged to spans, in array functions; a backend is any function of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let

LABELS = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION", "MISC": "CUSTOM:MISC"}
GATED = ("PERSON", "ORGANIZATION", "LOCATION")
PREDICTION = "array<struct<start:int,end:int,label:string,score:double>>"


def merged(tokens: str, how: str = "mean") -> Column:
    """Spans of BIO, BIOLU and S- tags: B, U and S open, I and L extend the same label or else open, all else ends a span.

    ``tokens`` is an array of (label, score, start, end); the score is the mean, largest or least of a span's tokens.
    """
    # A token's own label tells whether its span stays open behind it, so a token looks at the one before it alone.
    before = "{ts}[greatest(i - 1, 0)].label"
    code = f"transform({{ts}}, (t, i) -> case when t.label rlike '^[IL]-' and i > 0 and {before} rlike '^[BI]-' and substring({before}, 3) = substring(t.label, 3) then 2 when t.label rlike '^[BIULS]-' then 1 else 0 end)"
    firsts = lambda c: f"filter(transform({c}, (x, i) -> if(x = 1, i, -1)), i -> i >= 0)"
    lasts = lambda c: f"filter(transform({c}, (x, i) -> if(x > 0 and coalesce(get({c}, i + 1), 0) <> 2, i, -1)), i -> i >= 0)"
    scores = "transform(p, t -> cast(t.score as double))"
    value = {"mean": "aggregate(p, 0D, (sum_, t) -> sum_ + t.score) / size(p)", "max": f"array_max({scores})", "min": f"array_min({scores})"}[how]
    names = " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items())
    kind = "substring(p[0].label, 3)"
    span = f"named_struct('start', p[0].start, 'end', p[size(p) - 1].end, 'label', case {kind} {names} else {kind} end, 'score', {value})"
    parts = lambda ts, c: let(lasts(c), lambda to: f"transform({firsts(c)}, (a, k) -> slice({ts}, a + 1, {to}[k] - a + 1))")
    runs = let(tokens, lambda ts: let(code.format(ts=ts), lambda c: parts(ts, c)))
    return F.expr(f"transform({runs}, p -> {span})")


def softmax_argmax(logits: str) -> Column:
    """struct (at, p): the place of the largest of an array of numbers, the first of equal ones, and its share under a softmax, shifted by it."""
    top = f"array_max({logits})"
    return F.expr(f"named_struct('at', cast(array_position({logits}, {top}) - 1 as int), 'p', 1D / aggregate({logits}, 0D, (sum_, one_) -> sum_ + exp(one_ - {top})))")


def adapted(predictions: str, least: float = 0.5, types: tuple[str, ...] | None = None) -> Column:
    """Predictions at or above a score and of the types allowed; none for null."""
    allowed = f" and p.label in ({', '.join(repr(t) for t in types)})" if types else ""
    return F.expr(f"filter(coalesce({predictions}, cast(array() as {PREDICTION})), p -> p.score >= {least}D{allowed})")


def gate(entities: str, certain: float = 0.95, sure: float = 0.75) -> Column:
    """Whether a document is worth a model: an uncertain name, organization or place, or any score under ``sure``."""
    return F.exists(entities, lambda e: (e["score"] < certain) & (e["entity_type"].isin(*GATED) | (e["score"] < sure)))


def with_backend(found: DataFrame, key: str, backend: Callable[[list[str]], list[list[tuple]]], text: str = "text") -> DataFrame:
    """(key, predictions) of the gated documents alone; the backend is called once per batch and loaded once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "predictions": [[dict(zip(("start", "end", "label", "score"), p, strict=True)) for p in row] for row in backend(b[text].fillna("").tolist())]})

    kind = found.schema[key].dataType.simpleString()
    return found.where(gate("entities")).select(key, text).mapInPandas(run, f"{key} {kind}, predictions {PREDICTION}")
