"""Settings of an analysis, read from and written to JSON; unknown keys and values out of range are errors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import context, fusion, ner
from .operators.recognizers import DEFAULT_RULES, EU_RULES, chosen, detect
from .schema import parse_entity_type


@dataclass
class AnalysisConfig:
    language: str | None = None
    score_threshold: float = 0.5
    level: int = 1
    entities: list[str] | None = None
    disabled: list[str] = field(default_factory=list)
    eu: bool = False
    by_type: dict[str, float] = field(default_factory=dict)
    iou: float = 0.35
    gap: int = 1
    trace: bool = False
    l1_threshold: float = 0.0
    certain: float = 0.95
    weights: tuple[float, float, float] = fusion.WEIGHTS

    def checked(self) -> AnalysisConfig:
        if not 0 <= self.score_threshold <= 1 or not 0 < self.iou <= 1 or self.gap < 0 or self.level not in (1, 2, 3):
            raise ValueError("a setting is out of range")
        self.entities = None if self.entities is None else [parse_entity_type(e) for e in self.entities]
        self.by_type = {parse_entity_type(k): float(x) for k, x in self.by_type.items()}
        return self

    @classmethod
    def load(cls, text: str) -> AnalysisConfig:
        data = json.loads(text)
        if unknown := set(data) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**data).checked()

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=2)


def analyze(docs: DataFrame, config: AnalysisConfig | None = None, text: str = "text", key: str | None = None, backend: Callable[[list[str]], list[list[tuple]]] | None = None) -> DataFrame:
    """``docs`` with ``entities``, and ``trace`` if asked for.

    Level 1 detects. Level 2 moves scores by context and combinations. Level 3 calls ``backend`` for documents that its gate
    lets through; its entities join the others by ``key``, a unique column, past the filters of level 1. Scores of the levels
    are fused, overlaps resolved, neighbours merged, and what is under the threshold goes.
    """
    c = (config or AnalysisConfig()).checked()
    rules = chosen([*DEFAULT_RULES, *(EU_RULES if c.eu else [])], c.entities, tuple(c.disabled), c.language)
    if not rules:
        raise ValueError("no recognizer is left")
    src = f"coalesce({text}, '')"
    out = detect(docs, rules, text, "__l1", c.l1_threshold)
    if c.level >= 2:
        out = out.withColumn("__l2", context.adjusted("__l1", src, certain=c.certain, language=c.language or "en"))
        for rule in context.COMBINATIONS:
            out = out.withColumn("__l2", context.combined("__l2", rule, src, c.certain))
    out = out.withColumn("__items", fusion.candidates("__l1", "__l2" if c.level >= 2 else None, c.certain, c.weights))
    if c.level == 3 and backend is not None:
        if key is None:
            raise ValueError("level 3 needs a key column")
        seen = ner.with_backend(out.withColumn("entities", out["__l2"]), key, backend, text).withColumnRenamed("predictions", "__found")
        out = out.join(seen, key, "left").withColumn("__items", F.concat("__items", fusion.model_candidates("__found"))).drop("__found")
    if c.trace:
        out = out.withColumn("candidates", F.expr("transform(__items, i -> named_struct('start', i.start, 'end', i.end, 'entity_type', i.entity_type, 'score', i.score, 'recognizer', i.recognizer))"))
    out = out.withColumn("entities", fusion.resolve_levels("__items", src, c.iou, c.weights)).drop("__l1", "__l2", "__items")
    out = out.withColumn("entities", fusion.merge_adjacent("entities", src, c.gap))
    out = out.withColumn("entities", fusion.thresholds("entities", c.score_threshold, c.by_type))
    return out.withColumn("trace", fusion.trace("candidates", "entities", c.score_threshold)).drop("candidates") if c.trace else out
