"""The library's functions under SQL names. They are SQL functions, so queries that use them stay native."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.recognizers import DEFAULT_RULES, Rule, rule_sql
from ..schema import ENTITIES
from .validators import CHECKS


def register(spark: SparkSession, rules: list[Rule] | None = None, prefix: str = "pii_") -> list[str]:
    """``pii_<check>(s)`` for each check, ``pii_entities(text)`` and the table function ``pii_analyze(text)``; their names."""
    made = []
    for name, check in CHECKS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(s STRING) RETURNS BOOLEAN RETURN {check('s')}")
        made.append(f"{prefix}{name}")
    parts = ", ".join(rule_sql(r, "t") for r in (DEFAULT_RULES if rules is None else rules))
    merged = f"array_sort(concat({parts}, cast(array() as {ENTITIES})))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}entities(t STRING) RETURNS {ENTITIES} RETURN {merged}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}analyze(t STRING) RETURNS TABLE(start INT, end INT, entity_type STRING, text STRING, score DOUBLE, recognizer STRING) RETURN SELECT e.start, e.end, e.entity_type, e.text, e.score, e.recognizer FROM (SELECT explode({merged}) AS e)")
    return [*made, f"{prefix}entities", f"{prefix}analyze"]
