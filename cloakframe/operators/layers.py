"""Policies in layers and over time: folders of JSON merged key by key, checked by path, and versions that hold for a span.

A layer is a tree of maps. Of two layers the later one's values count; maps are merged key by key to any depth, a null
takes a key away, lists and plain values are replaced whole. The merged tree is checked against a shape, and every fault
is told with its path, all of them at once. Versions of policies are a table of (policy, entity_type, operator,
valid_from, valid_to); decisions take the version of their own time by a join on the policy and type with a range of
times, the table being configuration of ``MOST_ROWS`` rows at most and sent to all tasks, or joined by key if it is more.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .policy import PACKS, pack_operators

OPERATORS = ("redact", "replace", "mask", "hash", "encrypt", "fpe", "pseudonymize", "tokenize")
#: What a policy may hold: a type, a tuple of words, or a map of the same; "*" stands for any key.
SHAPE = {
    "name": str,
    "regulation": str,
    "entities": {"*": {"operator": OPERATORS, "score": float}},
    "retention": {"mapping_days": int, "audit_days": int},
    "minimization": {"strip_control_chars": bool, "max_text_length": int},
    "defaults": {"operator": OPERATORS, "on_unknown": ("log", "block", "redact")},
    "actions": {"block_high_risk": bool, "on_violation": list},
}
MOST_ROWS = 100_000
DIMENSION = "policy string, entity_type string, operator string"


def merged(*layers: dict) -> dict:
    """The layers as one tree, a later one over an earlier."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if value is None:
                out.pop(key, None)
            elif isinstance(value, dict):
                out[key] = merged(out[key] if isinstance(out.get(key), dict) else {}, value)
            else:
                out[key] = value
    return out


def faults(tree: object, shape: object = SHAPE, path: str = "") -> list[str]:
    """What is wrong with a tree, each fault with its path."""
    if isinstance(shape, dict):
        if not isinstance(tree, dict):
            return [f"{path or '.'}: a map is due, not {type(tree).__name__}"]
        out = []
        for key, value in tree.items():
            own = f"{path}.{key}" if path else str(key)
            out += faults(value, shape.get(key, shape.get("*")), own) if key in shape or "*" in shape else [f"{own}: unknown"]
        return out
    if isinstance(shape, tuple):
        return [] if tree in shape else [f"{path}: {tree!r} is none of {', '.join(shape)}"]
    fits = isinstance(tree, (int, float)) if shape is float else isinstance(tree, shape)
    return [] if fits and not (shape in (int, float) and isinstance(tree, bool)) else [f"{path}: {shape.__name__} is due, not {type(tree).__name__}"]


def normalized(tree: dict, name: str) -> dict:
    """A layer with names in lower case, types in upper case, and surrounding space gone; a layer without a name takes its file's."""
    out = dict(tree)
    out["name"] = str(out.get("name") or name).strip().lower()
    if isinstance(out.get("entities"), dict):
        out["entities"] = {str(k).strip().upper(): {x: v.strip().lower() if isinstance(v, str) else v for x, v in e.items()} if isinstance(e, dict) else e for k, e in out["entities"].items()}
    return out


def load(*folders: str) -> dict[str, dict]:
    """Policies by name from the JSON files of folders, a later folder's over an earlier's, on top of the built-in packs; all faults are one error."""
    found = {p: {"name": p, "regulation": PACKS[p][0], "entities": {t: {"operator": o} for t, o in pack_operators(p).items()}} for p in PACKS}
    wrong = []
    for folder in folders:
        for path in sorted(Path(folder).glob("*.json")):
            try:
                tree = json.loads(path.read_text(encoding="utf-8"))
            except ValueError as e:
                wrong.append(f"{path}: {e}")
                continue
            if not isinstance(tree, dict):
                wrong.append(f"{path}: a map is due")
                continue
            layer = normalized(tree, path.stem)
            whole = merged(found.get(layer["name"], {}), layer)
            wrong += [f"{path}: {x}" for x in faults(whole)]
            found[layer["name"]] = whole
    if wrong:
        raise ValueError("; ".join(wrong))
    return found


def rows_of(policies: dict[str, dict]) -> list[tuple[str, str, str]]:
    """(policy, entity_type, operator) of policies; the type * stands for all others."""
    out = []
    for name, p in policies.items():
        out += [(name, t, e.get("operator", "redact")) for t, e in p.get("entities", {}).items()]
        out.append((name, "*", p.get("defaults", {}).get("operator", "redact")))
    return out


def versions(spark: SparkSession, history: list[tuple[str, dict[str, dict]]]) -> DataFrame:
    """(policy, entity_type, operator, valid_from, valid_to) from what was loaded at each time; a policy's version ends where its next one begins.

    A policy that a later load does not hold any more ends there.
    """
    rows = [(p, t, o, at) for at, policies in history for p, t, o in rows_of(policies)]
    marks = sorted({at for at, _ in history})
    table = spark.createDataFrame(rows, f"{DIMENSION}, at string").withColumn("valid_from", F.to_timestamp("at"))
    ends = spark.createDataFrame([(a, b) for a, b in zip(marks, [*marks[1:], None], strict=True)], "at string, until string")
    return table.join(F.broadcast(ends), "at").select("policy", "entity_type", "operator", "valid_from", F.to_timestamp("until").alias("valid_to"))


def changes(versions_: DataFrame) -> DataFrame:
    """Versions without those that change nothing: neighbours of one operator are one span."""
    own = Window.partitionBy("policy", "entity_type").orderBy("valid_from")
    new = F.when((F.lag("operator").over(own) == F.col("operator")) & (F.lag("valid_to").over(own) == F.col("valid_from")), 0).otherwise(1)
    marked = versions_.withColumn("__new", new).withColumn("__span", F.sum("__new").over(own))
    return marked.groupBy("policy", "entity_type", "operator", "__span").agg(F.min("valid_from").alias("valid_from"), F.max_by("valid_to", "valid_from").alias("valid_to")).drop("__span")


def decided(rows: DataFrame, versions_: DataFrame, policy: str, entity_type: str, ts: str) -> DataFrame:
    """``rows`` with ``operator``: that of the policy's version at the row's time, for its type or else for all others; redact where there is none."""
    table = versions_.select(F.col("policy").alias("__policy"), F.col("entity_type").alias("__type"), F.col("operator").alias("__operator"), "valid_from", "valid_to")
    table = F.broadcast(table) if versions_.limit(MOST_ROWS + 1).count() <= MOST_ROWS else table
    out = rows
    for name, own in (("__own", F.col(entity_type)), ("__other", F.lit("*"))):
        when = (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
        out = out.join(table, (F.col(policy) == F.col("__policy")) & (own == F.col("__type")) & when, "left").withColumn(name, F.col("__operator")).drop("__policy", "__type", "__operator", "valid_from", "valid_to")
    return out.withColumn("operator", F.coalesce("__own", "__other", F.lit("redact"))).drop("__own", "__other")
