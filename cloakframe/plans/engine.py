"""Queries of the engine's further operators, each with SQL for another engine; they join those of ``catalog``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, registry
from ..functions import validators as v
from ..operators import anonymize as an
from ..operators import audit, context, evaluation, fusion, metrics, ner, policy, synthetic
from ..operators import recognizers as r
from ..session import spread
from ..sources import files, jsonpatch
from .catalog import _GOLD, _PRED, ALL_SQL, IP_SCAN, KEY, NONCE, SCANS, SPANS_SQL, _entries, _sides, docs_of, exploded, query, scanned, seeded, table
from .oracles import SEEDED, q, rules_sql, span_sql

LITERALS = ("password", "pass", "the", "there", "ein", "eine", "server", "http", "https")


@query(
    "SELECT doc_id, pattern, count(*) AS n, sum(start)::BIGINT AS starts FROM (SELECT doc_id, start, CASE lower(m) "
    + " ".join(f"WHEN {q(p)} THEN {k}" for k, p in enumerate(LITERALS))
    + f" END AS pattern FROM {span_sql('(?i)' + '|'.join(sorted(LITERALS, key=len, reverse=True)))}) GROUP BY doc_id, pattern"
)
def literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.each(docs_of(spark, sf_dir), r.literal_matches("coalesce(text, '')", LITERALS), "m", "doc_id")
    return rows.groupBy("doc_id", F.col("m.pattern").alias("pattern")).agg(F.count("*").alias("n"), F.sum("m.start").alias("starts"))


SPACES = "'[ \\t\\n\\x0B\\f\\r]+'"
_EDGES = "[" + "".join(f"\\{c}" if c in "()?." else c for c in context.EDGES) + "]"


def _lemmas(words: str, language: str) -> str:
    """A list of words as lemmas, in DuckDB SQL: one list function for each pass."""
    out = f"list_transform({words}, lambda t: lower(regexp_replace(trim(t), {q(f'^{_EDGES}+|{_EDGES}+$')}, '', 'g')))"
    cases = " ".join(f"WHEN t LIKE {q('%' + e)} AND strlen(t) >= {len(e.encode()) + 2} THEN left(t, length(t) - {len(e)})" for e in context.ENDINGS.get(language, context.ENDINGS[""]))
    for _ in range(context.CUTS):
        out = f"list_transform({out}, lambda t: CASE {cases} ELSE t END)"
    return out


@query(
    f"WITH words AS (SELECT DISTINCT lang, token FROM (SELECT lang, unnest(string_split_regex(text, {SPACES})) AS token FROM documents)) SELECT lang, token, CASE lang "
    + " ".join(f"WHEN {q(x)} THEN {_lemmas('[token]', x)}[1]" for x in context.ENDINGS if x)
    + f" ELSE {_lemmas('[token]', '')}[1] END AS lemma FROM words"
)
def lemma_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs_of(spark, sf_dir).select("lang", F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return words.select("lang", "token", F.expr(context.lemma_by("token", "lang")).alias("lemma"))


LEVEL_2 = [x for x in r.DEFAULT_RULES if x.entity in ("IBAN", "BANK_ACCOUNT")] + r.HEALTH_RULES


def _adjusted_sql() -> str:
    cases = []
    for rule in context.RULES[1:]:
        single = sorted({context.lemma_of(x) for x in rule.boost if " " not in x} - {""})
        phrases = " + ".join(f"contains(w, {q(x)})::INT" for x in rule.boost if " " in x) or "0"
        per = {x: sum(context.lemma_of(y) == x for y in rule.boost if " " not in y) for x in single}
        words = " + ".join(f"{n} * list_contains(l, {q(x)})::INT" for x, n in per.items()) or "0"
        cases.append(f"WHEN entity_type = {q(rule.entity)} THEN least(greatest(score + {rule.up} * ({phrases} + {words}), 0), 1)")
    return f"""WITH e AS (SELECT e.*, string_split_regex(left(d.text, start), {SPACES}) AS a, string_split_regex(substring(d.text, "end" + 1), {SPACES}) AS b FROM ({rules_sql(LEVEL_2)}) e JOIN {SEEDED} d USING (doc_id)),
      w AS (SELECT *, trim(regexp_replace(lower(array_to_string(a[greatest(len(a) - 5, 1):len(a) - 1], ' ') || ' ' || a[len(a)] || text || b[1] || ' ' || array_to_string(b[2:6], ' ')), {SPACES}, ' ', 'g')) AS w FROM e),
      l AS (SELECT *, {_lemmas("string_split(w, ' ')", 'en')} AS l FROM w)
      SELECT doc_id, start, recognizer, round((CASE WHEN score >= 0.95 THEN score {' '.join(cases)} ELSE score END)::DOUBLE, 6) AS score FROM l"""


@query(_adjusted_sql())
def context_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores moved by the words and phrases around, over texts with account numbers, bank codes and records."""
    found = r.detect(seeded(spark, sf_dir), LEVEL_2).withColumn("entities", context.adjusted("entities", "text"))
    return exploded(found, "doc_id").select("doc_id", "start", "recognizer", F.round("score", 6).alias("score"))


NEAR = context.Combination(("IP_ADDRESS", "PHONE"), 2000, 0.05, "net_phone")
_FIRST = f"""SELECT doc_id, a0, a1, b0, b1 FROM (SELECT a.doc_id, a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start, a."end", b.start, b."end") AS k
  FROM ({ALL_SQL}) a JOIN ({ALL_SQL}) b ON a.doc_id = b.doc_id AND a.entity_type = 'IP_ADDRESS' AND b.entity_type = 'PHONE' AND greatest(a."end", b."end") - least(a.start, b.start) <= 2000) WHERE k = 1"""
_BASE = "CASE e.entity_type WHEN 'IP_ADDRESS' THEN 0.9 WHEN 'PHONE' THEN 0.78 WHEN 'EMAIL_SCAN' THEN 0.88 ELSE 0.72 END"
_MEMBER = "((e.entity_type = 'IP_ADDRESS' AND e.start = f.a0) OR (e.entity_type = 'PHONE' AND e.start = f.b0))"
_BOOSTED = f"SELECT e.doc_id, e.start, e.entity_type, {_BASE} AS l1, {_BASE} + CASE WHEN coalesce({_MEMBER}, false) THEN 0.05 ELSE 0 END AS l2 FROM ({ALL_SQL}) e LEFT JOIN ({_FIRST}) f USING (doc_id)"


@query(f"SELECT doc_id, start, entity_type, round(l2::DOUBLE, 6) AS score FROM ({_BOOSTED})")
def quasi_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address and phone number that stand close enough are boosted."""
    found = scanned(spark, sf_dir).withColumn("entities", context.combined("entities", NEAR, "coalesce(text, '')"))
    return exploded(found, "doc_id").select("doc_id", "start", "entity_type", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, start, entity_type, round((l1 * 0.45 + l2 * 0.3) / 0.75, 6)::DOUBLE AS score, round(l2::DOUBLE, 6) AS l2 FROM ({_BOOSTED})")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two levels: the score before and after combinations, fused."""
    found = scanned(spark, sf_dir).withColumn("second", context.combined("entities", NEAR, "coalesce(text, '')"))
    rows = r.each(found, fusion.candidates("entities", "second"), "c", "doc_id")
    return rows.select("doc_id", "c.start", "c.entity_type", F.round("c.score", 6).alias("score"), F.round("c.l2", 6).alias("l2"))


REPORTED = (context.COMBINATIONS[1], NEAR)
DATED = [x for x in r.DEFAULT_RULES if x.entity in ("DATE", "ADDRESS")] + [IP_SCAN, *[x for x in SCANS if x.entity == "PHONE"]]
_DATED = rules_sql([x for x in r.DEFAULT_RULES if x.entity in ("DATE", "ADDRESS")])


def _close(kinds: tuple[str, str], within: int, rows: str) -> str:
    return f"EXISTS (SELECT 1 FROM {rows} a JOIN {rows} b ON a.doc_id = b.doc_id WHERE a.doc_id = d.doc_id AND a.entity_type = {q(kinds[0])} AND b.entity_type = {q(kinds[1])} AND greatest(a.\"end\", b.\"end\") - least(a.start, b.start) <= {within})"


_KEYWORDS = " OR ".join(f"contains(lower(text), {q(k.lower())})" for k in REPORTED[0].keywords)
_SEED_NETS = " UNION ALL ".join(f"SELECT doc_id, start, (start + length(m))::INTEGER AS \"end\", {q(x.entity)} AS entity_type FROM {span_sql(x.pattern, SEEDED)}" for x in DATED[2:])


@query(f"""WITH e AS MATERIALIZED (SELECT doc_id, start, "end", entity_type FROM ({_DATED}) UNION ALL {_SEED_NETS}), m AS (SELECT doc_id, (({_KEYWORDS}) AND {_close(('DATE', 'ADDRESS'), 3000, 'e')}) AS one, {_close(('IP_ADDRESS', 'PHONE'), 2000, 'e')} AS two FROM {SEEDED} d)
  SELECT doc_id, round((CASE WHEN one THEN 0.35 ELSE 0 END + CASE WHEN two THEN 0.025 ELSE 0 END)::DOUBLE, 6) AS risk_score, (one::INT + two::INT)::INT AS alerts FROM m""")
def quasi_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.detect(seeded(spark, sf_dir), DATED).select("doc_id", context.quasi_report("entities", "text", REPORTED).alias("q"))
    return found.select("doc_id", F.round("q.risk_score", 6).alias("risk_score"), F.size("q.alerts").alias("alerts"))


_TOPS = "max(l_discount) AS l1, max(CASE WHEN l_linenumber % 2 = 1 THEN l_tax END) AS l2, max(CASE WHEN l_linenumber % 3 = 0 THEN l_discount / 2 END) AS l3"


@query(f"SELECT l_orderkey, round((coalesce(l1 * 0.45, 0) + coalesce(l2 * 0.3, 0) + coalesce(l3 * 0.25, 0)) / (0.45 + CASE WHEN l2 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN l3 IS NULL THEN 0 ELSE 0.25 END), 9)::DOUBLE AS score FROM (SELECT l_orderkey, {_TOPS} FROM lineitem GROUP BY l_orderkey)")
def fuse_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as candidates of one place: one cluster, the largest score of each level, and their weighted mean."""
    n = F.lit(None).cast("double")
    item = F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit("X").alias("entity_type"), F.col("l_discount").cast("double").alias("score"), F.lit("r").alias("recognizer"), F.col("l_discount").cast("double").alias("l1"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_tax").cast("double")).otherwise(n).alias("l2"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount").cast("double") / 2).otherwise(n).alias("l3"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return rows.select("l_orderkey", F.round(fusion.resolve_levels("items", "''")[0]["score"], 9).alias("score"))


def _line_spans(spark: SparkSession, sf_dir: str, start: F.Column, end: F.Column) -> DataFrame:
    """An order's lines as spans with their return flag as the type."""
    item = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("l_returnflag").alias("entity_type"), F.lit("").alias("text"), F.lit(0.5).alias("score"), F.lit("r").alias("recognizer"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("entities"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + 8 + l_suppkey % 4 AS b, l_returnflag AS t FROM lineitem), g AS (SELECT *, (lag(t) OVER w IS DISTINCT FROM t OR a > lag(b) OVER w + 1)::INT AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b, t)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS k FROM g), m AS (SELECT l_orderkey, k, min(a) AS a, max(b) AS b FROM i GROUP BY l_orderkey, k) SELECT l_orderkey, count(*)::INT AS merged, sum(b - a)::BIGINT AS covered FROM m GROUP BY l_orderkey""")
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") * 10
    rows = _line_spans(spark, sf_dir, k, k + 8 + F.col("l_suppkey") % 4).withColumn("entities", fusion.merge_adjacent("entities", "''"))
    return rows.select("l_orderkey", F.size("entities").alias("merged"), F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"]).alias("covered"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_suppkey % 6 <= 2)::INT AS tp, count(*) FILTER (WHERE l_suppkey % 6 > 2)::INT AS fp, count(*) FILTER (WHERE l_suppkey % 6 > 2)::INT AS fn FROM lineitem GROUP BY l_orderkey")
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as gold spans, and the same moved by up to five places: those moved by two at most still overlap by half."""
    k, by = F.col("l_linenumber") * 10, F.col("l_suppkey") % 6
    span = lambda a: F.struct(a.cast("int").alias("start"), (a + 8).cast("int").alias("end"), F.lit("X").alias("entity_type"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span(k))).alias("g"), F.array_sort(F.collect_list(span(k + by))).alias("p"))
    rows = rows.select("l_orderkey", "g", "p", F.size(F.filter(evaluation.matched("g", "p"), lambda x: x >= 0)).alias("tp"))
    return rows.select("l_orderkey", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("g") - F.col("tp")).alias("fn"))


@query(f"""SELECT tp, fp, fn, round(tp / (tp + fp), 9)::DOUBLE AS precision, round(tp / (tp + fn), 9)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 9)::DOUBLE AS f1, round(5 * tp / (5 * tp + fp + 4 * fn), 9)::DOUBLE AS f2 FROM (
  SELECT count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM
  (SELECT DISTINCT doc_id, start, "end", entity_type, 1 AS g FROM ({_GOLD})) FULL JOIN (SELECT DISTINCT doc_id, start, "end", entity_type, 1 AS p FROM ({_PRED})) USING (doc_id, start, "end", entity_type))""")
def micro_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.totals(*_sides(spark, sf_dir)).select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f2")])


@query(f"SELECT CASE WHEN gold IN ('O', 'IP_ADDRESS') THEN gold ELSE 'MISMATCH' END AS gold, CASE WHEN seen IN ('O', 'IP_ADDRESS') THEN seen ELSE 'MISMATCH' END AS seen, sum(n)::BIGINT AS n FROM (SELECT coalesce(g.entity_type, 'O') AS gold, coalesce(p.entity_type, 'O') AS seen, count(*) AS n FROM ({_GOLD}) g FULL JOIN ({_PRED}) p ON g.doc_id = p.doc_id AND g.start = p.start AND g.\"end\" = p.\"end\" GROUP BY 1, 2) GROUP BY 1, 2")
def confusion_with_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.confusion(*_sides(spark, sf_dir))
    return rows.groupBy(evaluation.known_types("gold_type", ["IP_ADDRESS"]).alias("gold"), evaluation.known_types("predicted_type", ["IP_ADDRESS"]).alias("seen")).agg(F.sum("n").alias("n"))


@query(f"SELECT count(*) FILTER (WHERE g AND p) AS both, count(*) FILTER (WHERE g AND NOT p) AS missed FROM (SELECT bool_or(g) AS g, bool_or(NOT g) AS p FROM (SELECT DISTINCT doc_id, start, \"end\", entity_type, true AS g FROM ({_GOLD}) UNION ALL SELECT DISTINCT doc_id, start, \"end\", entity_type, false FROM ({_PRED})) GROUP BY doc_id, start, \"end\", entity_type)")
def span_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of both sides, and of gold alone, by set operations."""
    gold, seen = (x.select(*evaluation.SPAN) for x in _sides(spark, sf_dir))
    both = gold.intersect(seen).select(F.lit(1).alias("both"), F.lit(0).alias("missed"))
    return both.unionByName(gold.distinct().exceptAll(seen.distinct()).select(F.lit(0).alias("both"), F.lit(1).alias("missed"))).agg(F.sum("both").alias("both"), F.sum("missed").alias("missed"))


@query("SELECT c_custkey, 0 AS one, length(c_name) + 1 AS two, -1 AS three FROM customer")
def span_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_name").alias("t"), F.array("c_name", "c_name", F.lit("absent")).alias("vs"))
    rows = rows.withColumn("a", evaluation.allocated("t", "vs"))
    return rows.select("c_custkey", *[F.col("a")[k]["start"].cast("long").alias(n) for k, n in enumerate(("one", "two", "three"))])


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber * 5 AS a, l_linenumber * 5 + 1 + l_suppkey % 9 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem),
  st AS (SELECT l_orderkey, k, a, b, 1 AS n, b - a AS total FROM s WHERE k = 1 UNION ALL
    SELECT s.l_orderkey, s.k, CASE WHEN s.a >= st.b OR s.b - s.a > st.b - st.a THEN s.a ELSE st.a END, CASE WHEN s.a >= st.b OR s.b - s.a > st.b - st.a THEN s.b ELSE st.b END,
      CASE WHEN s.a >= st.b THEN st.n + 1 ELSE st.n END, CASE WHEN s.a >= st.b THEN st.total + s.b - s.a WHEN s.b - s.a > st.b - st.a THEN st.total - (st.b - st.a) + s.b - s.a ELSE st.total END FROM st JOIN s ON s.l_orderkey = st.l_orderkey AND s.k = st.k + 1)
  SELECT l_orderkey, arg_max(n, k)::INT AS kept, arg_max(total, k)::BIGINT AS covered FROM st GROUP BY l_orderkey""")
def without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") * 5
    rows = _line_spans(spark, sf_dir, k, k + 1 + F.col("l_suppkey") % 9).withColumn("s", evaluation.without_overlaps("entities"))
    return rows.select("l_orderkey", F.size("s").alias("kept"), F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"]).alias("covered"))


MARKERS = ["the", "server", "and", "http", "der", "les"]
_HITS = " + ".join(f"(contains(t, {q(m)}) OR contains(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g'), {q(m)}))::INT" for m in MARKERS)


@query(f"SELECT doc_id, ({_HITS})::INT AS hits, ({_HITS}) >= 4 AS covered FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def marker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", evaluation.coverage("coalesce(text, '')", MARKERS, 70).alias("c")).select("doc_id", "c.hits", "c.covered")


@query(f"SELECT doc_id, entity_type, string_agg(start::VARCHAR, ',' ORDER BY start) AS starts FROM ({ALL_SQL}) GROUP BY doc_id, entity_type")
def grouped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.each(scanned(spark, sf_dir), evaluation.grouped("entities"), "g", "doc_id")
    return rows.select("doc_id", "g.entity_type", F.array_join(F.transform("g.entities", lambda e: e["start"].cast("string")), ",").alias("starts"))


@query("SELECT window_start, round(p, 6) AS p FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, quantile_cont(value, 0.99) AS p FROM events GROUP BY 1) WHERE p > 50")
def p99_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_alerts(table(spark, sf_dir, "events"), "ts", F.col("value"), above=50).withColumn("p", F.round("p", 6))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) FILTER (WHERE value > 100) AS increase FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 100) > 0")
def increase_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.increase_alerts(table(spark, sf_dir, "events"), "ts", F.col("value") > 100)


@query("SELECT le, (SELECT count(*) FROM lineitem WHERE l_quantity <= le) AS n FROM (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in metrics.linear_buckets(1, 5, 20)) + ", 'inf'::DOUBLE]) AS le)")
def linear_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), metrics.linear_buckets(1, 5, 20))


@query("SELECT least(a, b) || '|' || greatest(a, b) AS pair, count(*) AS n FROM (SELECT o_orderstatus AS a, left(o_orderpriority, 1) AS b FROM orders UNION ALL SELECT left(o_orderpriority, 1), o_orderstatus FROM orders) GROUP BY 1")
def approver_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two approvers, named in either order, counted by pair."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.left("o_orderpriority", F.lit(1)).alias("b"))
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(metrics.pair_key("a", "b").alias("pair")).agg(F.count("*").alias("n"))


#: Requests of four guards, numbered in order, for SQL that walks them one by one.
GUARDED_SQL = "WITH RECURSIVE r AS (SELECT user_id % 4 AS g, floor(epoch(ts))::BIGINT AS tm, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY floor(epoch(ts)), event_id) AS k FROM events),"


@query(f"""{GUARDED_SQL} s(g, k, tm, event_id, state, times, until) AS (
  SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, -1::BIGINT, '', []::BIGINT[], 0::BIGINT FROM r UNION ALL
  SELECT g, k, tm, event_id, state, CASE state WHEN 'open' THEN times WHEN 'tripped' THEN live ELSE list_append(live, tm) END, CASE state WHEN 'tripped' THEN tm + 900 ELSE until END FROM (
    SELECT *, CASE WHEN tm < until THEN 'open' WHEN len(live) >= 5 THEN 'tripped' ELSE 'allowed' END AS state FROM (
      SELECT r.g, r.k, r.tm, r.event_id, s.times, s.until, list_filter(s.times, lambda x: x >= r.tm - 900) AS live FROM s JOIN r ON r.g = s.g AND r.k = s.k + 1)))
SELECT g AS guard, tm AS "at", event_id, state FROM s WHERE k > 0""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("guard"), F.unix_timestamp("ts").alias("at"), "event_id")
    return metrics.breaker(rows, "guard", "at", "event_id")


NEW_KEY = "unhex(repeat('1e', 32))"
KEYS = {"k1": KEY, "k2": NEW_KEY}


@query("SELECT 0::BIGINT AS mismatches, count(*) AS n, 'enc:v1:k2:' AS prefix FROM customer")
def key_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sealed under one key, moved to another, and opened."""
    rows = table(spark, sf_dir, "customer").withColumn("old", F.expr(an.sealed_under("k1", KEY, "a", NONCE)("''", "c_name", "''"))).withColumn("new", F.expr(an.rotated("old", KEYS, "k2", "a", NONCE)))
    bad = F.expr(f"if({an.opened('old', KEYS, 'a')} = c_name and {an.opened('new', KEYS, 'a')} = c_name and old <> new, 0, 1)")
    return rows.select(bad.alias("bad"), F.left("new", F.lit(10)).alias("p")).agg(F.sum("bad").alias("mismatches"), F.count("*").alias("n"), F.max("p").alias("prefix"))


@query("SELECT 0::BIGINT AS mismatches, count(*) AS n FROM documents")
def decrypted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities sealed under a named key; texts put back from the sealed values, not from stored originals."""
    found = scanned(spark, sf_dir).withColumn("entities", fusion.longest_only("entities"))
    out = an.anonymize(found, {"*": an.sealed_under("k1", KEY, "", NONCE)})
    back = an.deanonymize("anonymized.text", "anonymized.transformations", an.opened("t.replacement", KEYS))
    return out.agg(F.sum(F.when(back.eqNullSafe(F.coalesce("text", F.lit(""))), 0).otherwise(1)).alias("mismatches"), F.count("*").alias("n"))


@query(f"SELECT doc_id, start, length(m)::INT AS n, true AS back FROM {SPANS_SQL['CREDIT_CARD']}")
def policy_fpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards under a pack that asks for digits: as long as before, and reversible with the key."""
    ops = an.operators_by_policy(policy.pack_operators("pci-dss"), KEY, NONCE)
    out = an.anonymize(r.detect(docs_of(spark, sf_dir), [x for x in SCANS if x.entity == "CREDIT_CARD"]), ops)
    rows = r.each(out, "anonymized.transformations", "t", "doc_id").select("doc_id", "t.*")
    back = F.expr(an.format_preserving(KEY, NONCE, back=True)("''", "replacement", "''"))
    return rows.select("doc_id", "start", F.length("replacement").alias("n"), (back == F.col("text")).alias("back"))


@query(f"SELECT doc_id, count(entity_type)::INT AS strict, count(entity_type) FILTER (WHERE entity_type = 'IP_ADDRESS')::INT AS some FROM documents LEFT JOIN ({ALL_SQL}) e USING (doc_id) GROUP BY doc_id")
def response_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark, sf_dir).select("doc_id", policy.response("entities", "gdpr-strict").alias("a"), policy.response("entities", "ccpa", ("IP_ADDRESS",)).alias("b"))
    return rows.select("doc_id", F.col("a.redacted").alias("strict"), F.size(F.filter("b.entities", lambda e: e["text"] == "[REDACTED]")).alias("some"))


_RISKY_SQL = " + ".join(f"bool_or(e.entity_type IN ({', '.join(map(q, g))}))::INT" for g in policy.RISKY)
RISKY_RULES = [x for x in [*r.DEFAULT_RULES, *r.EU_RULES] if any(x.entity in g for g in policy.RISKY)]


@query(f"SELECT doc_id, coalesce({_RISKY_SQL}, 0) >= 2 AS blocked FROM documents d LEFT JOIN ({rules_sql(RISKY_RULES)}) e USING (doc_id) GROUP BY doc_id")
def blocked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold two kinds of risky data, which a strict pack does not answer."""
    rows = r.detect(seeded(spark, sf_dir), RISKY_RULES).select("doc_id", "entities")
    return rows.select("doc_id", policy.response("entities", "hipaa")["blocked"].alias("blocked"))


@query(f"SELECT doc_id, ({_RISKY_SQL}) >= 2 AS risky FROM ({rules_sql(RISKY_RULES)}) e GROUP BY doc_id")
def high_risk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = exploded(r.detect(seeded(spark, sf_dir), RISKY_RULES), "doc_id").groupBy("doc_id").agg(F.collect_set("entity_type").alias("types"))
    return types.select("doc_id", policy.high_risk(F.col("types")).alias("risky"))


@query("SELECT c_custkey, sha256('gdpr-analytics|' || c_custkey || '|2024-01-01 00:00:00') AS mapping_key, TIMESTAMP '2024-01-31 00:00:00' AS expires_at FROM customer")
def mapping_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    kept = policy.registered(table(spark, sf_dir, "customer"), "c_custkey", "gdpr-analytics", now)
    return kept.unionByName(policy.registered(table(spark, sf_dir, "customer"), "c_custkey", "hipaa", now)).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("SELECT conv_id, sha256(string_agg(regexp_replace(coalesce(text, ''), '[0-9]', '#', 'g'), chr(10) ORDER BY turn, role, text)) AS texts FROM conversations GROUP BY conv_id")
def chat_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as request bodies, their texts changed inside the JSON, and taken out again; a null text is an empty one."""
    rows = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.array(F.struct("role", F.coalesce("text", F.lit("")).alias("content"))).alias("messages")))
    rows = jsonpatch.with_changed(rows.select("conv_id", "turn", "role", "text", body.alias("body")), "body", lambda t: f"regexp_replace({t}, '[0-9]', '#')")
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.get_json_object("body", "$.messages[0].content").alias("t")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("xs", lambda x: x["t"]), "\n"), 256).alias("texts"))


@query("SELECT user_id, count(*)::INT AS steps, count(DISTINCT event_type)::INT AS hints FROM events GROUP BY user_id")
def merged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.struct("event_id")).alias("transformations"), F.create_map("event_type", F.col("event_id").cast("string")).alias("hints"))
    return an.merged_payloads(rows, "user_id", "event_id").select("user_id", F.size("transformations").alias("steps"), F.size("hints").alias("hints"))


@query(f"SELECT doc_id, count(*)::INT AS results, '2.1.0' AS version, 'CLOAKFRAME/IP_ADDRESS' AS rule FROM {SPANS_SQL['IP_ADDRESS']} GROUP BY doc_id")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.each(r.detect(docs_of(spark, sf_dir), [IP_SCAN]), "entities", "e", F.col("doc_id").cast("string").alias("path"), "text").select("path", "text", "e.start", "e.end", "e.entity_type")
    logs = files.sarif_logs(rows)
    shape = "struct<version:string,runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>>"
    return logs.select(F.col("path").cast("long").alias("doc_id"), F.from_json("log", shape).alias("x")).select("doc_id", F.size(F.col("x.runs")[0]["results"]).alias("results"), "x.version", F.col("x.runs")[0]["tool"]["driver"]["rules"][0]["id"].alias("rule"))


@query(f"SELECT doc_id, start, doc_id || ':' || start || ':' || (start + length(m)) AS fingerprint FROM {SPANS_SQL['IP_ADDRESS']}")
def code_quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.each(r.detect(docs_of(spark, sf_dir), [IP_SCAN]), "entities", "e", F.col("doc_id").cast("string").alias("path"), "text").select("path", "text", "e.start", "e.end", "e.entity_type")
    print_ = files.code_quality(rows).select(F.get_json_object("issue", "$.fingerprint").alias("fingerprint"))
    return print_.select(F.split("fingerprint", ":")[0].cast("long").alias("doc_id"), F.split("fingerprint", ":")[1].cast("int").alias("start"), "fingerprint")


@query("SELECT c_custkey, 5::INT AS ids, 5::INT AS accounts FROM customer")
def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer a personal number and an account number of five countries, each with right check digits."""
    checks = {"FR": v.nir, "DE": v.steuer_id, "IT": v.codice_fiscale, "ES": v.dni, "NL": v.bsn}
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", *[synthetic.fake(k, "c_custkey", 7, cc).alias(f"{k}_{cc}") for cc in checks for k in ("NATIONAL_ID", "IBAN")])
    ids = " + ".join(f"cast({f(f'NATIONAL_ID_{cc}')} as int)" for cc, f in checks.items())
    accounts = " + ".join(f"cast({v.iban_plausible(f'IBAN_{cc}')} and {v.iban_mod97(f'IBAN_{cc}')} as int)" for cc in checks)
    return rows.select("c_custkey", F.expr(ids).alias("ids"), F.expr(accounts).alias("accounts"))


@query("SELECT count(*) AS n, count(*) AS placed, 6::BIGINT AS languages, true AS hard FROM orders")
def corpus_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made from the keys of orders: the value stands where the span says, and near a fifth hold a near miss."""
    rows = synthetic.corpus_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
    return rows.agg(F.count("*").alias("n"), F.sum(F.expr("cast(substring(text, start + 1, end - start) = value as int)")).alias("placed"), F.countDistinct("lang").alias("languages"), F.avg((F.col("entity_type") == "O").cast("int")).between(0.14, 0.22).alias("hard"))


@query("SELECT event_id FROM events WHERE contains(event_type, 'c') AND value >= 100")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).withColumn("actor", F.lit(""))
    return audit.searched(rows, "C", success=False).select("event_id")


@query("SELECT page_id, regexp_matches(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS has_email, regexp_matches(html, '\\+[0-9][0-9 .()-]{7,}[0-9]') AS has_phone FROM pages")
def sql_model_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sql_model_hits(table(spark, sf_dir, "pages"), "html").select("page_id", "has_email", "has_phone")


TOLD = [x for x in r.DEFAULT_RULES if x.name in ("iban_iso13616", "eu_vat_intracom")] + r.ARTICLE_9_RULES + r.ID_RULES[:4]
_MOD97 = "list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substring(u, 5) || left(u, 4), ''), lambda c: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::VARCHAR), ''), ''), lambda c: c::INT), lambda a, c: (a * 10 + c) % 97) = 1"


@query(f"""SELECT doc_id, start, CASE WHEN recognizer LIKE 'gdpr_%' THEN 'gdpr_art9_keywords' WHEN recognizer LIKE 'fr_%' THEN 'fr_national_identity' ELSE recognizer END AS recognizer,
  CASE WHEN entity_type = 'IBAN' THEN 'checksum_ok=' || ({_MOD97}) || ';iban_normalized=' || u || ';level=regex' WHEN recognizer = 'eu_vat_intracom' THEN 'level=regex;vat_rule=vat_' || lower(left(text, 2))
    WHEN recognizer LIKE 'gdpr_%' THEN 'gdpr_article=9;human_review_recommended=true;level=regex;rule=' || recognizer ELSE 'level=regex;rule=' || recognizer END AS metadata FROM (SELECT *, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS u FROM ({rules_sql(TOLD)}))""")
def entity_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.detect(seeded(spark, sf_dir), TOLD).withColumn("entities", r.with_metadata("entities"))
    rows = r.each(rows, "entities", "e", "doc_id")
    return rows.select("doc_id", "e.start", "e.recognizer", F.array_join(F.transform("e.metadata", lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("metadata"))


SWEDISH = r.Registry([*r.DEFAULT_RULES, *r.EU_RULES]).get_by_language("sv")
ITALIAN_IDS = r.Registry(r.EU_RULES).remove("eu_license_plates").get_by_entity("tax_id")


@query(f"SELECT recognizer, count(*) AS n FROM ({rules_sql(SWEDISH)}) GROUP BY recognizer")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(r.detect(seeded(spark, sf_dir), SWEDISH), "doc_id").groupBy("recognizer").agg(F.count("*").alias("n"))


@query(f"SELECT recognizer, count(*) AS n FROM ({rules_sql(ITALIAN_IDS)}) GROUP BY recognizer")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(r.detect(seeded(spark, sf_dir), ITALIAN_IDS), "doc_id").groupBy("recognizer").agg(F.count("*").alias("n"))


MIXED = [x for x in r.DEFAULT_RULES if x.name in ("email_rfc5322_like", "url", "date_eu_iso")]


@query(f"SELECT doc_id, start, entity_type FROM ({rules_sql(MIXED)}) WHERE score >= CASE entity_type WHEN 'EMAIL' THEN 0.9 WHEN 'DATE' THEN 0.66 ELSE 0.5 END")
def type_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.detect(seeded(spark, sf_dir), MIXED)
    return exploded(found.withColumn("entities", fusion.thresholds("entities", 0.5, {"EMAIL": 0.9, "DATE": 0.66})), "doc_id").select("doc_id", "start", "entity_type")


@query(f"""WITH e AS MATERIALIZED ({rules_sql(MIXED)}) SELECT doc_id, start, "end", entity_type FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.doc_id = e.doc_id AND o.start < e."end" AND e.start < o."end" AND (o.start, o."end", o.entity_type) <> (e.start, e."end", e.entity_type)
  AND (o."end" - o.start > e."end" - e.start OR (o."end" - o.start = e."end" - e.start AND (o.score > e.score OR (o.score = e.score AND (o.start < e.start OR (o.start = e.start AND o.entity_type < e.entity_type)))))))""")
def longest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.detect(seeded(spark, sf_dir), MIXED)
    return exploded(found.withColumn("entities", fusion.longest_only("entities")), "doc_id").select("doc_id", "start", "end", "entity_type")


@query(f"SELECT doc_id, entity_type, count(*) AS n, count(*) FILTER (WHERE score >= 0.7) AS passed FROM ({rules_sql(MIXED)}) GROUP BY doc_id, entity_type")
def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each candidate at a threshold of 0.7."""
    found = r.detect(seeded(spark, sf_dir), MIXED).withColumn("kept", fusion.thresholds("entities", 0.7))
    rows = r.each(found, fusion.trace("entities", "kept", 0.7), "t", "doc_id")
    return rows.groupBy("doc_id", "t.entity_type").agg(F.count("*").alias("n"), F.sum(F.col("t.steps")[1]["passed"].cast("long")).alias("passed"))


@query(f"SELECT x.doc_id, start, strlen(left(text, start))::INT AS first_byte, strlen(left(text, start + length(m)))::INT AS last_byte FROM {SPANS_SQL['IP_ADDRESS']} x JOIN documents USING (doc_id)")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.detect(docs_of(spark, sf_dir), [IP_SCAN]).withColumn("b", fusion.byte_offsets("entities", "text"))
    rows = r.each(found, F.arrays_zip("entities", "b"), "z", "doc_id")
    return rows.select("doc_id", F.col("z.entities.start").alias("start"), F.col("z.b.start").alias("first_byte"), F.col("z.b.end").alias("last_byte"))


def _those(rows: DataFrame, found: F.Column, count: str) -> DataFrame:
    """(doc_id, fields of ``found``) where its ``count`` is above 0; a plain filter would be pushed below what it counts and make that twice."""
    return r.each(rows, F.filter(F.array(found), lambda x: x[count] > 0), "x", "doc_id").select("doc_id", "x.*")


_TOKENS = span_sql("[^ \\t\\n\\x0B\\f\\r]+")


@query(f"SELECT doc_id, count(*)::INT AS tokens, sum(start)::BIGINT AS starts FROM {_TOKENS} GROUP BY doc_id")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(docs_of(spark, sf_dir)).where("text is not null").select("doc_id", evaluation.tokens("text").alias("t"))
    found = F.struct(F.size("t").alias("tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("starts"))
    return _those(rows, found, "tokens")


@query(f"""SELECT t.doc_id, count(*) FILTER (WHERE t.start = s.start) AS firsts, count(*) AS n FROM {_TOKENS} t JOIN (SELECT doc_id, start, start + length(m) AS stop FROM {span_sql('[0-9][0-9. ]*[0-9]')}) s
  ON t.doc_id = s.doc_id AND s.start <= t.start AND t.start + length(t.m) <= s.stop GROUP BY t.doc_id""")
def iob_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside runs of numbers, tagged as the run's beginning or its inside."""
    rule = r.Rule("numbers", "CUSTOM:NUMBERS", "[0-9][0-9. ]*[0-9]", 0.9, against=())
    found = r.each(r.detect(docs_of(spark, sf_dir).where("text is not null"), [rule]), F.filter(F.array("entities"), lambda e: F.size(e) > 0), "entities", "doc_id", "text")
    tags = found.select("doc_id", evaluation.spans_to_tags(f"({evaluation.tokens_sql('text')})", "entities").alias("tags"))
    out = F.struct(F.size(F.filter("tags", lambda t: t.startswith("B-"))).cast("long").alias("firsts"), F.size(F.filter("tags", lambda t: t != "O")).cast("long").alias("n"))
    return _those(tags, out, "n")


@query(f"SELECT doc_id, coalesce(bool_or(e.entity_type = 'CREDIT_CARD'), false) AS gated FROM documents LEFT JOIN ({ALL_SQL}) e USING (doc_id) GROUP BY doc_id")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are worth a model: here those with a card, whose score is the only one under 0.75."""
    return scanned(spark, sf_dir).select("doc_id", ner.gate("entities").alias("gated"))


@query("SELECT l_orderkey, l_linenumber, (list_position(x, list_max(x)) - 1)::INT AS at, round(1 / list_sum(list_transform(x, lambda z: exp(z - list_max(x)))), 9)::DOUBLE AS p FROM (SELECT l_orderkey, l_linenumber, [l_discount * 10, l_tax * 10, l_quantity / 50]::DOUBLE[] AS x FROM lineitem)")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array((F.col("l_discount") * 10).cast("double"), (F.col("l_tax") * 10).cast("double"), (F.col("l_quantity") / 50).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).withColumn("s", ner.softmax_argmax("x"))
    return rows.select("l_orderkey", "l_linenumber", F.col("s.at").alias("at"), F.round("s.p", 9).alias("p"))


@query(f"SELECT DISTINCT token, trim(regexp_replace(replace(replace(replace(translate(lower(token), {q(synthetic.ACCENTS)}, {q(synthetic.PLAIN)}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', '.', 'g'), '.') AS slug FROM (SELECT unnest(string_split_regex(text, {SPACES})) AS token FROM documents)")
def name_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs_of(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return words.select("token", F.expr(synthetic.slug("token")).alias("slug"))


@query(f"SELECT doc_id, count(entity_type)::INT AS n FROM documents LEFT JOIN (SELECT * FROM ({ALL_SQL}) WHERE entity_type = 'PHONE') USING (doc_id) GROUP BY doc_id")
def adapted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans taken as a model's predictions: those of one type at or above a score pass."""
    rows = scanned(spark, sf_dir).withColumn("p", F.expr("transform(entities, e -> named_struct('start', e.start, 'end', e.end, 'label', e.entity_type, 'score', e.score))"))
    return rows.select("doc_id", F.size(ner.adapted("p", 0.75, ("PHONE", "CREDIT_CARD"))).alias("n"))


_IP_TEXT = f"regexp_replace(text, {q(IP_SCAN.pattern)}, '[REDACTED]', 'g')"


@query(f"SELECT doc_id, regexp_matches(text, {q(IP_SCAN.pattern)}) AS blocked, sha256({_IP_TEXT}) AS redacted, sha256(text) AS logged, sha256(text) AS back FROM documents WHERE text IS NOT NULL")
def guard_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under the four modes of a guard; the round trip ends where it began."""
    rows = r.detect(docs_of(spark, sf_dir).where("text is not null"), [IP_SCAN])
    for mode in policy.GUARD_MODES:
        rows = policy.guarded(rows, mode, column=mode)
    back = an.restore("roundtrip.text", "roundtrip.pairs")
    return rows.select("doc_id", F.col("block.text").isNull().alias("blocked"), F.sha2("redact.text", 256).alias("redacted"), F.sha2("log.text", 256).alias("logged"), F.sha2(back, 256).alias("back"))


@query(f"SELECT entity_type, 'unknown' AS level, count(*) AS n FROM ({ALL_SQL}) GROUP BY entity_type")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of types taken from analysis results in JSON."""
    return metrics.result_counts(scanned(spark, sf_dir).select(F.to_json(F.struct("entities")).alias("result")))


_CAPITALS = f"SELECT doc_id, start, start + length(m) AS stop, 0.5 + (length(m) % 10) / 20.0 AS score, regexp_matches(m, '^[A-Z]') AS up, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM {_TOKENS}"


@query(f"""WITH s AS (SELECT doc_id, min(start) AS a, max(stop) AS b, avg(score) AS score FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY start) AS run FROM ({_CAPITALS}) WHERE up) GROUP BY doc_id, run)
  SELECT doc_id, count(*)::INT AS spans, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends, round(sum(score), 4)::DOUBLE AS score FROM s GROUP BY doc_id""")
def bio_merge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a capital as a model's inside tags: each run of them opens and extends one span."""
    rows = spread(docs_of(spark, sf_dir)).where("text is not null").select("doc_id", evaluation.tokens("text").alias("t"))
    tag = F.transform("t", lambda x: F.struct(F.when(x["m"].rlike("^[A-Z]"), "I-PER").otherwise("O").alias("label"), (F.lit(0.5) + (F.length(x["m"]) % 10) / 20).alias("score"), x["start"].alias("start"), x["end"].alias("end")))
    spans = rows.select("doc_id", tag.alias("tags")).select("doc_id", ner.merged("tags").alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[f])
    score = F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"]), 4)
    return _those(spans, F.struct(F.size("s").alias("spans"), total("start").alias("starts"), total("end").alias("ends"), score.alias("score")), "spans")


FF3_KEY, FF3_TWEAK = bytes(range(16)), bytes(7)


@query("SELECT 0::BIGINT AS mismatches, 0::BIGINT AS unchanged, count(*) AS n FROM customer")
def ff3_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits of customer numbers under FF3-1 and back: as long as before, and other digits."""
    @F.pandas_udf("struct<sealed:string,back:string>")
    def both(s: pd.Series) -> pd.DataFrame:
        sealed = crypto.ff3_1_texts(FF3_KEY, FF3_TWEAK, s.tolist())
        return pd.DataFrame({"sealed": sealed, "back": crypto.ff3_1_texts(FF3_KEY, FF3_TWEAK, sealed, True)})

    rows = spread(table(spark, sf_dir, "customer")).select(F.lpad(F.regexp_replace("c_name", "[^0-9]", ""), 9, "0").alias("d")).withColumn("x", both("d"))
    bad = ~((F.col("x.back") == F.col("d")) & (F.length("x.sealed") == F.length("d")))
    return rows.agg(F.sum(bad.cast("long")).alias("mismatches"), F.sum((F.col("x.sealed") == F.col("d")).cast("long")).alias("unchanged"), F.count("*").alias("n"))


_NAMES = [*evaluation.ALIASES, "EMAIL", "OTHER"]


@query(f"SELECT l_orderkey, l_linenumber, CASE name {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in evaluation.ALIASES.items())} ELSE name END AS label FROM (SELECT l_orderkey, l_linenumber, ([{', '.join(map(q, _NAMES))}])[l_suppkey % {len(_NAMES)} + 1] AS name FROM lineitem)")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine's type names as the library's own."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_suppkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").withColumn("name", name).select("l_orderkey", "l_linenumber", evaluation.mapped("name").alias("label"))


@query(f"SELECT d.doc_id, count(m)::INT AS n, coalesce(sum(start), 0)::BIGINT AS starts FROM documents d LEFT JOIN {SPANS_SQL['IP_ADDRESS']} s USING (doc_id) GROUP BY d.doc_id")
def sql_function_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions by their SQL names, in a query text."""
    registry.register(spark, [IP_SCAN], "own_")
    docs_of(spark, sf_dir).createOrReplaceTempView("own_documents")
    return spark.sql("SELECT doc_id, size(e) AS n, aggregate(e, 0L, (a, x) -> a + x.start) AS starts FROM (SELECT doc_id, own_entities(coalesce(text, '')) AS e FROM own_documents)")


@query(f"""SELECT d.doc_id, 'pass' AS transparent, CASE WHEN count(e.entity_type) > 0 THEN 'anonymize' ELSE 'pass' END AS anonymize, CASE WHEN coalesce(bool_or(e.entity_type = 'PHONE'), false) THEN 'block' ELSE 'pass' END AS block,
  CASE WHEN coalesce(bool_or(e.entity_type = 'PHONE'), false) THEN 'alert' ELSE 'pass' END AS alert FROM documents d LEFT JOIN ({ALL_SQL}) e USING (doc_id) GROUP BY d.doc_id""")
def proxy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = ("transparent", "anonymize", "block", "alert")
    return scanned(spark, sf_dir).select("doc_id", *[policy.decision("entities", m, ("PHONE",), 0.7).alias(m) for m in modes])
