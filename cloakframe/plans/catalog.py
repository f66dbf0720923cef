"""Named queries of the library over the driver's tables, each with SQL for another engine where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.sqltext import digits
from ..operators import anonymize as an
from ..operators import audit, evaluation, fusion, metrics, ner, policy, synthetic
from ..operators.recognizers import CARD_RUN, DEFAULT_RULES, EU_RULES, IP_AGAINST, IP_FOR, Rule, _alternation, detect, each, exploded
from ..sources import files
from .oracles import SAMPLES, SEEDED, q, rules_sql, span_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


# Patterns that all regular-expression engines read alike on these texts.
EMAIL_RUN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE_US = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP_RULE = next(r for r in DEFAULT_RULES if r.name == "ipv4")
plain = lambda rule: replace(rule, words=(), against=(), invalidate=(), deny=(), least=0.0)
IP_SCAN = plain(IP_RULE)
EMAIL_SCAN = Rule("email", "EMAIL_SCAN", EMAIL_RUN.replace("+@", "++@"), 0.88, least=0.0, against=())
PHONE_SCAN = Rule("phone", "PHONE", PHONE_US, 0.78, least=0.0, against=())
CARD_SHAPE = Rule("card_shape", "CREDIT_CARD", CARD_RUN, 0.72, least=0.0, against=())
CARD_SCAN = replace(CARD_SHAPE, name="card", check=v.card)
SCANS = [IP_SCAN, EMAIL_SCAN, PHONE_SCAN, CARD_SCAN]


LUHN_SQL = """(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(d, length(d) - i + 1, 1)::INT
  ELSE (2 * substring(d, length(d) - i + 1, 1)::INT) // 10 + (2 * substring(d, length(d) - i + 1, 1)::INT) % 10 END)) % 10 = 0)"""
NETWORK_SQL = "regexp_full_match(d, '(4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|3[47][0-9]{13}|6[0-9]{15}|6[0-9]{18}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12})')"
CARDS_SQL = f"(SELECT doc_id, start, m, before, after FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM {span_sql(CARD_RUN)}) WHERE {NETWORK_SQL} AND {LUHN_SQL})"
SPANS_SQL = {"IP_ADDRESS": span_sql(IP_RULE.pattern), "EMAIL_SCAN": span_sql(EMAIL_RUN), "PHONE": span_sql(PHONE_US), "CREDIT_CARD": CARDS_SQL}
ALL_SQL = " UNION ALL ".join(f"SELECT doc_id, start, (start + length(m))::INTEGER AS \"end\", {q(k)} AS entity_type, m AS text FROM {s}" for k, s in SPANS_SQL.items())


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share and read again, for what more than one side of a plan reads."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new folder under the one that the session names in ``spark.checkpoint.dir``; one machine has its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or '/tmp/checkpoints').rstrip('/')}/cloakframe-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def scan(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: exploded(detect(docs_of(spark, d), [rule]), "doc_id").select("doc_id", "start", "end", "text")


for _name, _rule, _sql in (("scan_ipv4", IP_SCAN, SPANS_SQL["IP_ADDRESS"]), ("scan_email_raw", EMAIL_SCAN, SPANS_SQL["EMAIL_SCAN"]), ("scan_phone_nanp", PHONE_SCAN, SPANS_SQL["PHONE"]), ("scan_card_shape", CARD_SHAPE, span_sql(CARD_RUN)), ("scan_card_luhn", CARD_SCAN, CARDS_SQL)):
    QUERIES[_name] = scan(_rule)
    ORACLE_SQL[_name] = f'SELECT doc_id, start, (start + length(m))::INTEGER AS "end", m AS text FROM {_sql}'


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(docs_of(spark, sf_dir), SCANS)


@query(f"SELECT lang, entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({ALL_SQL}) JOIN documents USING (doc_id) GROUP BY lang, entity_type")
def entity_counts_by_type_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(scanned(spark, sf_dir), "doc_id", "lang")
    return rows.groupBy("lang", "entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


flagship = entity_counts_by_type_lang


@query(f"SELECT entity_type, lang, count(*) AS n FROM ({ALL_SQL}) JOIN documents USING (doc_id) GROUP BY ROLLUP (entity_type, lang)")
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(scanned(spark, sf_dir), "doc_id", "lang").rollup("entity_type", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, start, (start + length(m))::INTEGER AS \"end\", regexp_matches(lower(m), 'example\\.com|example\\.org|example\\.net|test\\.com|invalid|localhost') AS denied FROM {SPANS_SQL['EMAIL_SCAN']}")
def deny_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    deny = next(r for r in DEFAULT_RULES if r.entity == "EMAIL").deny
    rows = exploded(detect(docs_of(spark, sf_dir), [EMAIL_SCAN]), "doc_id")
    return rows.select("doc_id", "start", "end", F.lower("text").rlike(_alternation(deny)).alias("denied"))


_NEAR = "lower(before || m || after)"


@query(f"""SELECT doc_id, start, round(least(0.9 + CASE WHEN regexp_matches({_NEAR}, {q(_alternation(IP_FOR))}) THEN 0.05 ELSE 0 END, 1) - 0.1 * len(regexp_extract_all({_NEAR}, {q(_alternation(IP_AGAINST))})), 6)::DOUBLE AS score FROM {SPANS_SQL['IP_ADDRESS']}""")
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(detect(docs_of(spark, sf_dir), [replace(IP_RULE, least=0.0)]), "doc_id")
    return rows.select("doc_id", "start", "score")


@query(f"SELECT round(count(DISTINCT e.doc_id) / (SELECT count(*) FROM documents), 9)::DOUBLE AS rate FROM ({ALL_SQL}) e")
def docs_flagged_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.false_positive_rate(scanned(spark, sf_dir)).select(F.round("rate", 9).alias("rate"))


@query(f"SELECT entity_type, count(*) AS n FROM ({ALL_SQL}) GROUP BY entity_type ORDER BY n DESC, entity_type LIMIT 3")
def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(exploded(scanned(spark, sf_dir), "doc_id"), "entity_type", 3)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with one of the sample texts behind it, so that every type of entity occurs."""
    sample = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), sample).alias("text"))


FOUND = ["doc_id", "start", "end", "entity_type", "text", "score", "recognizer"]
OWNERS: dict[str, list[Rule]] = {}
for _rule in DEFAULT_RULES:
    OWNERS.setdefault(_rule.owner, []).append(_rule)
for _rule in EU_RULES:
    OWNERS.setdefault(_rule.owner, []).append(_rule)


def recognized(rules: list[Rule]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: exploded(detect(seeded(spark, d), rules), "doc_id").select(*FOUND)


for _name, _rules in {**{f"recognize_{o}": r for o, r in OWNERS.items()}, "detect_default": DEFAULT_RULES, "detect_eu": EU_RULES}.items():
    QUERIES[_name] = recognized(_rules)
    ORACLE_SQL[_name] = rules_sql(_rules)


@query()
def analyze_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default recognizers, resolved, merged and cut at the threshold."""
    return exploded(fusion.analyze(detect(docs_of(spark, sf_dir))), "doc_id")


@query(f"SELECT a.doc_id, a.entity_type AS a_type, a.start AS a_start, b.entity_type AS b_type, b.start AS b_start FROM ({ALL_SQL}) a JOIN ({ALL_SQL}) b ON a.doc_id = b.doc_id AND a.start < b.\"end\" + 2000 AND b.start < a.\"end\" + 2000 AND a.entity_type < b.entity_type")
def near_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(scanned(spark, sf_dir), "doc_id")
    a, b = (rows.select("doc_id", *[F.col(c).alias(f"{t}_{c}") for c in ("entity_type", "start", "end")]) for t in "ab")
    both = a.join(b, "doc_id").where("a_start < b_end + 2000 and b_start < a_end + 2000 and a_entity_type < b_entity_type")
    return both.select("doc_id", F.col("a_entity_type").alias("a_type"), "a_start", F.col("b_entity_type").alias("b_type"), "b_start")


@query(f"SELECT doc_id, sum(length(m))::BIGINT AS covered, count(*) AS n FROM {SPANS_SQL['IP_ADDRESS']} GROUP BY doc_id")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span given twice: clusters give each back once."""
    twice = detect(docs_of(spark, sf_dir), [IP_SCAN, replace(IP_SCAN, name="again", base=0.5)])
    rows = exploded(twice.withColumn("entities", fusion.resolve_overlaps("entities")), "doc_id")
    return rows.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount * 0.45 + l_tax * 0.3) / 0.75, 9)::DOUBLE AS both, round(l_discount, 9)::DOUBLE AS one FROM lineitem")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("double")
    return rows.select("l_orderkey", "l_linenumber", F.round(fusion.fuse_weighted(F.col("l_discount"), F.col("l_tax"), none), 9).alias("both"), F.round(fusion.fuse_weighted(F.col("l_discount"), none, none), 9).alias("one"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(least(l_quantity, 30) - greatest(0, 10), 0) / (l_quantity + 20 - greatest(least(l_quantity, 30) - 10, 0)), 9)::DOUBLE AS iou FROM lineitem""")
def span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(fusion.span_iou(F.lit(0.0), F.col("l_quantity"), F.lit(10.0), F.lit(30.0)), 9).alias("iou"))


@query("SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 2) AS masked, 'sha256:' || left(sha256(c_name), 16) AS hashed, '⟨PERSON:' || left(sha256('salt|PERSON|' || c_name), 10) || '⟩' AS pseudonym FROM customer")
def mask_hash_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {"masked": an.mask(2), "hashed": an.hashed(), "pseudonym": an.pseudonym("salt")}
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(op("'PERSON'", "c_name", "'1'")).alias(n) for n, op in ops.items()])


@query(f"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), {q(IP_RULE.pattern)}, '<IP_ADDRESS>', 'g')) AS text_sha256 FROM documents")
def replace_tag_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.anonymize(detect(docs_of(spark, sf_dir), [IP_SCAN]), {"IP_ADDRESS": an.replace()})
    return out.select("doc_id", F.sha2("anonymized.text", 256).alias("text_sha256"))


@query(f"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), {q(EMAIL_RUN)}, '', 'g')) AS text_sha256 FROM documents")
def redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.anonymize(detect(docs_of(spark, sf_dir), [EMAIL_SCAN]), {"*": an.redact()})
    return out.select("doc_id", F.sha2("anonymized.text", 256).alias("text_sha256"))


@query(f"SELECT doc_id, start, '<IP_ADDRESS_' || row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) || '>' AS replacement FROM {SPANS_SQL['IP_ADDRESS']}")
def numbered_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.anonymize(detect(docs_of(spark, sf_dir), [IP_SCAN]), {"IP_ADDRESS": an.replace(numbered=True)})
    return each(out, "anonymized.transformations", "t", "doc_id").select("doc_id", "t.start", "t.replacement")


@query("SELECT 0::BIGINT AS mismatches, count(*) AS n FROM documents")
def deanonymize_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked, then put back from the stored originals."""
    found = detect(docs_of(spark, sf_dir), SCANS)
    out = an.anonymize(found.withColumn("entities", fusion.longest_only("entities")), {"*": an.mask(2)})
    back = an.deanonymize("anonymized.text", "anonymized.transformations")
    return out.agg(F.sum(F.when(back.eqNullSafe(F.coalesce("text", F.lit(""))), 0).otherwise(1)).alias("mismatches"), F.count("*").alias("n"))


KEY, NONCE = "unhex(repeat('0f', 32))", "unhex(repeat('01', 12))"


@query("SELECT 0::BIGINT AS mismatches, count(*) AS n FROM customer")
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("sealed", F.expr(an.encrypted(KEY, "aad", NONCE)("'PERSON'", "c_name", "'1'")))
    return rows.select(F.expr(f"if({an.decrypted('substring(sealed, 1)', KEY, 'aad')} = c_name, 0, 1)").alias("bad")).agg(F.sum("bad").alias("mismatches"), F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS mismatches, count(*) AS n FROM customer")
def fpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("moved", F.expr(an.format_preserving(KEY, NONCE)("''", "c_name", "'1'")))
    back = F.expr(an.format_preserving(KEY, NONCE, back=True)("''", "moved", "'1'"))
    bad = F.when((back == F.col("c_name")) & (F.length("moved") == F.length("c_name")), 0).otherwise(1)
    return rows.agg(F.sum(bad).alias("mismatches"), F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(left(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1000000), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def minimize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", policy.minimized(F.col("text"), 1_000_000).alias("text"))


_STRICT = " ".join(f"WHEN {q(t)} THEN {q(o)}" for t, o in policy.pack_operators("gdpr-strict").items())


@query(f"SELECT entity_type, CASE entity_type {_STRICT} ELSE 'redact' END AS operator, count(*) AS n FROM ({ALL_SQL}) GROUP BY entity_type, operator")
def policy_operator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.with_operators(exploded(scanned(spark, sf_dir), "doc_id"), "gdpr-strict").groupBy("entity_type", "operator").agg(F.count("*").alias("n"))


@query(f"SELECT entity_type, count(*) AS n FROM ({ALL_SQL}) WHERE entity_type IN ('EMAIL', 'PHONE', 'IP_ADDRESS') GROUP BY entity_type")
def rbac_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.visible_to(exploded(scanned(spark, sf_dir), "doc_id"), "operator").groupBy("entity_type").agg(F.count("*").alias("n"))


_WEIGHTS = ", ".join(f"({q(k)}, {w})" for k, w in policy.SENSITIVITY.items())
_PACKS = ", ".join(f"({q(p)}, {x[2]}, {x[5]}, {x[6]})" for p, x in policy.PACKS.items())
_OPS = ", ".join(f"({q(p)}, {q(t)})" for p in policy.PACKS for t in policy.pack_operators(p))


@query(f"""SELECT policy, s AS score, CASE WHEN s >= 85 THEN 'critical' WHEN s >= 65 THEN 'high' WHEN s >= 40 THEN 'moderate' ELSE 'low' END AS band FROM (
  SELECT p.policy, least(greatest(5 + coalesce(sum(coalesce(w.weight, 10)) FILTER (WHERE o.entity_type IS NOT NULL), 0) + CASE WHEN any_value(p.blocks) THEN 5 ELSE 0 END + CASE WHEN any_value(p.days) > 90 THEN 10 ELSE 0 END - CASE WHEN any_value(p.strips) THEN 8 ELSE 0 END, 0), 100)::BIGINT AS s
  FROM (VALUES {_PACKS}) p(policy, days, blocks, strips) LEFT JOIN (SELECT * FROM (VALUES {_OPS}) o(policy, entity_type) WHERE entity_type IN (SELECT entity_type FROM ({ALL_SQL}))) o USING (policy) LEFT JOIN (VALUES {_WEIGHTS}) w(entity_type, weight) ON w.entity_type = o.entity_type GROUP BY p.policy)""")
def dpia_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's impact by the types that it treats and that documents hold."""
    there = exploded(scanned(spark, sf_dir)).select("entity_type").distinct()
    return policy.impact_scores(spark, policy.operator_dimension(spark).select("policy", "entity_type").join(there, "entity_type", "left_semi"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS kept, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS removed")
def erasure_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    rest, certificates = policy.erased(table(spark, sf_dir, "orders"), gone, "o_custkey")
    kept = rest.select(F.lit(1).alias("kept"), F.lit(0).alias("removed"))
    return kept.unionByName(certificates.select(F.lit(0).alias("kept"), F.col("removed").cast("int").alias("removed"))).agg(F.sum("kept").alias("kept"), F.sum("removed").alias("removed"))


# Gold: addresses and cards; predicted: addresses but those with a last part over 199, cards by shape, and phones.
_GOLD = f"SELECT * FROM ({ALL_SQL}) WHERE entity_type IN ('IP_ADDRESS', 'CREDIT_CARD')"
_SHAPES = f"SELECT doc_id, start, (start + length(m))::INTEGER AS \"end\", 'CREDIT_CARD' AS entity_type, m AS text FROM {span_sql(CARD_RUN)}"
_PRED = f"SELECT * FROM ({ALL_SQL}) WHERE entity_type = 'PHONE' OR (entity_type = 'IP_ADDRESS' AND NOT regexp_matches(text, '\\.2[0-9][0-9]$')) UNION ALL {_SHAPES}"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted spans: both lists are made in one pass over the texts and written, as two sides of a join read them."""
    found = detect(detect(docs_of(spark, sf_dir), SCANS), [CARD_SHAPE], column="shapes")
    mark = lambda c, side, keep: F.transform(F.filter(c, keep), lambda e: F.struct(F.lit(side).alias("side"), e["start"].alias("start"), e["end"].alias("end"), e["entity_type"].alias("entity_type")))
    gold = mark("entities", "gold", lambda e: e["entity_type"].isin("IP_ADDRESS", "CREDIT_CARD"))
    seen = mark("entities", "seen", lambda e: (e["entity_type"] == "PHONE") | ((e["entity_type"] == "IP_ADDRESS") & ~e["text"].rlike(r"\.2[0-9][0-9]$")))
    rows = kept(each(found, F.concat(gold, seen, mark("shapes", "seen", lambda e: F.lit(True))), "s", "doc_id").select("doc_id", "s.*"))
    return rows.where("side = 'gold'"), rows.where("side = 'seen'")


@query(f"""SELECT entity_type, tp, fp, fn, tp + fn AS support, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9)::DOUBLE AS f1, round(CASE WHEN 5 * tp + fp + 4 * fn > 0 THEN 5 * tp / (5 * tp + fp + 4 * fn) ELSE 0 END, 9)::DOUBLE AS f2 FROM (
  SELECT entity_type, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM
  (SELECT DISTINCT doc_id, start, "end", entity_type, 1 AS g FROM ({_GOLD})) FULL JOIN (SELECT DISTINCT doc_id, start, "end", entity_type, 1 AS p FROM ({_PRED})) USING (doc_id, start, "end", entity_type) GROUP BY entity_type)""")
def prf_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_type(*_sides(spark, sf_dir)).select("entity_type", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f2")])


@query(f"SELECT coalesce(g.entity_type, 'O') AS gold_type, coalesce(p.entity_type, 'O') AS predicted_type, count(*) AS n FROM ({_GOLD}) g FULL JOIN ({_PRED}) p ON g.doc_id = p.doc_id AND g.start = p.start AND g.\"end\" = p.\"end\" GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(*_sides(spark, sf_dir))


@query("SELECT t / 10 AS threshold, count(*) FILTER (WHERE least(floor(l_discount * 100 + 1e-9), 10) >= t)::BIGINT AS kept, count(*) FILTER (WHERE least(floor(l_discount * 100 + 1e-9), 10) < t)::BIGINT AS ignored FROM lineitem, range(11) r(t) GROUP BY t")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_curve(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score")), "score")


@query("SELECT round(quantile_cont(value, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95, round(quantile_cont(value, 0.99), 6)::DOUBLE AS p99 FROM events")
def percentiles_event_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return p.select(*[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS failure_ratio FROM events GROUP BY 1, 2")
def events_window_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.window_rates(table(spark, sf_dir, "events"), "ts", F.col("value") > 100, keys=("event_type",))
    return rates.withColumn("failure_ratio", F.round("failure_ratio", 9))


@query("SELECT window_start, n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1) WHERE r > 0.05")
def error_ratio_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alerts(metrics.window_rates(table(spark, sf_dir, "events"), "ts", F.col("value") > 100)).select("window_start", "n")


@query("SELECT event_id, n AS recent, n <= 2 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events)")
def guard_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.guarded(table(spark, sf_dir, "events"), "ts", "user_id", seconds=3600, most=2).select("event_id", "recent", "allowed")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 20")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.page(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], 2).select("c_custkey", "c_name")


_BOUNDS = ", ".join(f"({b})" for b in metrics.BUCKETS)


@query(f"SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM (SELECT le::DOUBLE AS le FROM (VALUES {_BOUNDS}, ('inf'::DOUBLE)) b(le))")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), F.col("value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 9)::DOUBLE AS delta FROM events")
def event_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.deltas(table(spark, sf_dir, "events"), "event_id", "value", "user_id").select("event_id", F.round("delta", 9).alias("delta"))


@query("SELECT o_orderkey, regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]', '_', 'g') AS label FROM orders")
def sanitized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(evaluation.label("o_orderpriority")).alias("label"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select((F.col("user_id") % 8).alias("log"), "event_id", F.col("ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("/v1/a=b").alias("endpoint"), F.lit("POST").alias("method"), F.col("event_id").cast("string").alias("request_id"), (F.col("value") < 100).alias("success"), F.lit(200).alias("status_code"))


@query("SELECT user_id % 8 AS log, count(*) AS entries, 0::BIGINT AS broken FROM events GROUP BY 1")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verified(audit.chained(_entries(spark, sf_dir), "log", "event_id"), "log", "event_id")


@query("SELECT event_id, 'CEF:0|cloakframe|gateway|1.0|' || event_type || '|' || event_type || '|' || CASE WHEN value < 100 THEN '3' ELSE '8' END || '|requestId=' || event_id || ' endpt=/v1/a\\=b method=POST code=200 actor=' || user_id AS line FROM events")
def audit_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", audit.cef().alias("line"))


@query("SELECT event_id, 'LEEF:2.0|cloakframe|gateway|1.0|' || event_type || '|sev=' || CASE WHEN value < 100 THEN '3' ELSE '8' END || chr(9) || 'usr=' || user_id || chr(9) || 'uri=/v1/a=b' || chr(9) || 'method=POST' || chr(9) || 'success=' || CASE WHEN value < 100 THEN 'true' ELSE 'false' END || chr(9) || 'code=200' || chr(9) || 'rid=' || event_id AS line FROM events")
def audit_leef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", audit.leef().alias("line"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tail(table(spark, sf_dir, "events"), "event_id", 50).select("event_id")


@query("SELECT c_custkey, len(regexp_extract_all(c_name, '[0-9]{9}')) AS n FROM customer")
def customer_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.recognizers import scan_columns

    rule = Rule("customer_no", "CUSTOM:CUSTOMER", "[0-9]{9}", 0.9, against=())
    return scan_columns(table(spark, sf_dir, "customer"), ["c_name"], [rule]).select("c_custkey", F.size("c_name_entities").cast("long").alias("n"))


_URL = r"https?://[A-Za-z0-9./_-]+"


@query(f"SELECT page_id, len(regexp_extract_all(html, {q(_URL)})) AS n FROM pages")
def page_url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("page_url", "URL", _URL, 0.7, against=())
    return detect(table(spark, sf_dir, "pages"), [rule], "html").select("page_id", F.size("entities").cast("long").alias("n"))


@query("SELECT conv_id, count(text) AS parts, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY conv_id")
def chat_body_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as request bodies of one message each, taken apart again."""
    body = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", body.alias("body")).select("conv_id", files.chat_texts().alias("texts"))
    chars = F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t))
    return rows.groupBy("conv_id").agg(F.sum(F.size("texts")).alias("parts"), F.sum(chars).alias("chars"))


@query("SELECT count(*) AS n, count(*) AS cards, count(*) AS ibans, count(*) AS ids FROM orders")
def synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fake cards, account numbers and ids made from the keys of orders have right check digits."""
    rows = table(spark, sf_dir, "orders").select(*[synthetic.fake(k, "o_orderkey").alias(a) for k, a in (("CREDIT_CARD", "c"), ("IBAN", "i"), ("NATIONAL_ID", "n"))])
    return rows.select(*[F.expr(e).cast("int").alias(n) for n, e in (("cards", v.card("c")), ("ibans", v.iban_mod97("i")), ("ids", v.nir("n")))]).agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in ("cards", "ibans", "ids")])


@query("""SELECT c_custkey AS id, start + c_custkey AS start, "end" + c_custkey AS "end", label, score FROM customer JOIN (VALUES (1, 0, 11, 'PERSON', 0.85::DOUBLE), (1, 20, 25, 'LOCATION', 0.7::DOUBLE), (0, 0, 4, 'ORGANIZATION', 0.6::DOUBLE)) t(odd, start, "end", label, score) ON odd = c_custkey % 2""")
def bio_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's tags for each customer, one of two kinds, moved by the key."""
    kinds = {1: [("B-PER", 0.9, 0, 4), ("I-PER", 0.8, 5, 11), ("O", 0.9, 12, 19), ("I-LOC", 0.7, 20, 25)], 0: [("U-ORG", 0.6, 0, 4), ("O", 0.9, 5, 9)]}
    at = lambda n: (F.col("c_custkey") + n).cast("int")
    tags = {k: F.array(*[F.struct(F.lit(x).alias("label"), F.lit(p).alias("score"), at(a).alias("start"), at(b).alias("end")) for x, p, a, b in v]) for k, v in kinds.items()}
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 1, tags[1]).otherwise(tags[0]).alias("tokens"))
    return each(rows, ner.merged("tokens"), "s", "id").select("id", "s.start", "s.end", "s.label", F.round("s.score", 6).alias("score"))


@query("""SELECT c_custkey AS id, start + c_custkey % 3 AS start, "end" + c_custkey % 3 AS "end", label FROM customer, (VALUES (0, 2, 'PER'), (3, 4, 'LOC')) t(start, "end", label)""")
def iob_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each customer behind none, one or two that are outside."""
    tags = F.concat(F.array_repeat(F.lit("O"), (F.col("c_custkey") % 3).cast("int")), F.array(*map(F.lit, ["B-PER", "I-PER", "O", "I-LOC"])))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tags.alias("tags"))
    return each(rows.withColumn("tags", evaluation.refined("tags")), evaluation.tags_to_spans("tags"), "s", "id").select("id", "s.*")


@query(f"SELECT d.doc_id, CASE WHEN count(e.entity_type) FILTER (WHERE e.entity_type = 'CREDIT_CARD') > 0 THEN 'block' ELSE 'pass' END AS decision FROM documents d LEFT JOIN ({ALL_SQL}) e USING (doc_id) GROUP BY d.doc_id")
def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("doc_id", policy.decision("entities", "block", ("CREDIT_CARD",)).alias("decision"))


@query(f"SELECT doc_id, start, 1 + (length(left(text, start)) - length(replace(left(text, start), chr(10), '')))::INTEGER AS line FROM {SPANS_SQL['IP_ADDRESS']} JOIN documents USING (doc_id)".replace("JOIN documents", "x JOIN documents"))
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each(detect(docs_of(spark, sf_dir), [IP_SCAN]), "entities", "e", "doc_id", F.col("text").alias("body")).select("doc_id", "body", "e.start")
    return rows.select("doc_id", "start", files.line_and_column("body", "start")[0].alias("line"))


@query("SELECT count(*) AS docs, 0::BIGINT AS mismatches FROM documents")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity counts of a stream over the documents against those of a batch."""
    from ..streaming import streams

    stream = streams.read_rows(spark, f"{sf_dir}/documents.parquet*", "doc_id long, text string, lang string, source string, n_chars long")
    found = streams.detect_stream(stream, SCANS).select("doc_id", F.size("entities").alias("n"))
    out = streams.run_to_files(found, shared_path(spark), shared_path(spark))
    batch = scanned(spark, sf_dir).select("doc_id", F.size("entities").alias("m"))
    both = out.join(batch, "doc_id", "full")
    return both.agg(F.count("*").alias("docs"), F.sum(F.when(F.col("n").eqNullSafe(F.col("m")), 0).otherwise(1)).alias("mismatches"))


VECTORS = [("luhn", "79927398713", True), ("luhn", "79927398714", False), ("card", "4532015112830366", True), ("card", "4532015112830367", False), ("iban_mod97", "FR7630006000011234567890189", True), ("iban_mod97", "FR7630006000011234567890188", False), ("bic", "BNPAFRPP", True), ("dni", "12345678Z", True), ("dni", "12345678A", False), ("pesel", "44051401359", True), ("pesel", "44051401358", False), ("steuer_id", "86095742719", True), ("steuer_id", "86095742718", False), ("siren", "732829320", True), ("date", "1.2.3", False), ("date", "2024-12-31", True)]


@query("SELECT c_custkey, check_name, value, valid FROM customer JOIN (VALUES " + ", ".join(f"({k}, {q(c)}, {q(x)}, {str(ok).lower()})" for k, (c, x, ok) in enumerate(VECTORS)) + f") t(k, check_name, value, valid) ON k = c_custkey % {len(VECTORS)}")
def validator_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values, right and wrong, dealt to customers, each under its check."""
    vectors = F.array(*[F.struct(F.lit(c).alias("check_name"), F.lit(x).alias("value")) for c, x, _ in VECTORS])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(vectors, (F.col("c_custkey") % len(VECTORS) + 1).cast("int")).alias("v")).select("c_custkey", "v.*")
    cases = " ".join(f"when check_name = '{c}' then {v.CHECKS[c]('value')}" for c in sorted({c for c, _, _ in VECTORS}))
    return rows.select("c_custkey", "check_name", "value", F.expr(f"case {cases} end").alias("valid"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS d FROM customer")
def digits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(digits("c_name")).alias("d"))
