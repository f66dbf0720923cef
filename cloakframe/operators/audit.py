"""Audit rows: hash chains, their check, tails and exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["ts", "actor", "action", "endpoint", "method", "request_id", "success", "status_code"]


def body(columns: list[str] | None = None) -> Column:
    """An entry's text: its fields as JSON, without hashes."""
    return F.to_json(F.struct(*(columns or FIELDS)))


def chained(entries: DataFrame, log: str, order: str, heads: dict[str, str] | None = None) -> DataFrame:
    """Entries with ``prev_hash`` and ``entry_hash``: SHA-256 over the hash before, a bar and the entry. A log is one chain.

    A log's entries pass through one task in order, as a stream, which is the sequence that a chain is; logs are dealt to
    tasks. ``heads`` gives the last hash of a log that is carried on, by the log's name as text.
    """
    src = entries.withColumn("body", body())
    schema = src.withColumn("prev_hash", F.lit("")).withColumn("entry_hash", F.lit("")).schema
    known = heads or {}

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = None, ""
        for part in parts:
            prev, own = [], []
            for name, text in zip(part[log], part["body"], strict=True):
                if name != now:
                    now, before = name, known.get(str(name), "")
                prev.append(before)
                before = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
                own.append(before)
            yield part.assign(prev_hash=prev, entry_hash=own)

    return src.repartition(log).sortWithinPartitions(log, order).mapInPandas(chain, schema)


def heads_of(chain: DataFrame, log: str, order: str) -> dict[str, str]:
    """The last hash of each log, to carry its chain on after a restart."""
    return {str(r[log]): r["head"] for r in chain.groupBy(log).agg(F.max_by("entry_hash", order).alias("head")).collect()}


def rotated(chain: DataFrame, log: str, order: str, most_bytes: int = 100 << 20) -> DataFrame:
    """Entries with ``file``, the number of the file of their log that holds them: a new one begins where the bytes before fill it."""
    size = F.sum(F.octet_length("body")).over(Window.partitionBy(log).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return chain.withColumn("file", F.floor(F.coalesce(size, F.lit(0)) / most_bytes).cast("int"))


def searched(entries: DataFrame, text: str = "", success: bool | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Entries whose actor or action holds a text, with this outcome, in a span of time."""
    out = entries.where(F.contains(F.lower("actor"), F.lit(text.lower())) | F.contains(F.lower("action"), F.lit(text.lower()))) if text else entries
    out = out if success is None else out.where(F.col("success") == success)
    out = out if since is None else out.where(F.col("ts") >= since)
    return out if until is None else out.where(F.col("ts") < until)


def verified(chain: DataFrame, log: str, order: str) -> DataFrame:
    """(log, entries, broken): entries whose hash, or whose link to the one before, does not hold. Needs no sequential pass."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(log).orderBy(order)), F.lit(""))
    own = F.sha2(F.concat("prev_hash", F.lit("|"), "body"), 256)
    marked = chain.select(log, ((F.col("prev_hash") != before) | (F.col("entry_hash") != own)).cast("long").alias("bad"))
    return marked.groupBy(log).agg(F.count("*").alias("entries"), F.sum("bad").alias("broken"))


def tail(entries: DataFrame, order: str, n: int = 1000) -> DataFrame:
    return entries.orderBy(F.desc(order)).limit(n)


def _escaped(c: str) -> Column:
    out = F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(F.replace(out, F.lit("="), F.lit("\\=")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def cef(vendor: str = "cloakframe", product: str = "gateway") -> Column:
    """An entry as a CEF line; severity is 3, or 8 without success."""
    severity = F.when(F.col("success"), "3").otherwise("8")
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|1.0|"), _escaped("action"), F.lit("|"), _escaped("action"), F.lit("|"), severity, F.lit("|requestId="), _escaped("request_id"), F.lit(" endpt="), _escaped("endpoint"), F.lit(" method="), _escaped("method"), F.lit(" code="), F.col("status_code").cast("string"), F.lit(" actor="), _escaped("actor"))


def leef(vendor: str = "cloakframe", product: str = "gateway") -> Column:
    parts = [F.concat(F.lit(f"LEEF:2.0|{vendor}|{product}|1.0|"), "action", F.lit("|sev="), F.when(F.col("success"), "3").otherwise("8"))]
    parts += [F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("usr", "actor"), ("uri", "endpoint"), ("method", "method"), ("success", "success"), ("code", "status_code"), ("rid", "request_id"))]
    return F.concat_ws("\t", *parts)
