"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.oracles import digits, luhn, span_sql
from . import additive, alignment, chat, filteraudit, linededup, matroska, maxent, minhash, packing, sentencepieces, toxicity, weakpii, winnowing
from .common import documents


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.document_digest(documents(spark, sf_dir))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(documents(spark, sf_dir))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return additive.search(table, table.where("vec_id % 50 = 0"), k=5)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakpii.span_digest(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_ids(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.conversation_digest(chat.format_segments(convs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op12: lengths, and the hash of each text with its last half taken from the next document."""
    return winnowing.fingerprints(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1: lengths and hash of each payload, read back from its media."""
    return matroska.document_digest(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: its counts and the base score, after one training step."""
    out = maxent.score_documents(documents(spark, sf_dir), 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op4: counts and hash of the base spans."""
    return weakpii.span_digest(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _crc32(text: str) -> str:
    """DuckDB SQL of crc32 over a text of digits and signs, bit by bit."""
    step = "xor(a, b)"
    for _ in range(8):
        step = f"xor(({step}) >> 1, 3988292384::UBIGINT * (({step}) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::UBIGINT)), lambda a, b: {step}), 4294967295::UBIGINT)"


_IP_PARTS = "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0"
_BASE_SPANS = f"""SELECT doc_id, 0 AS k, 'email' AS kind, start, start + length(m) AS stop FROM {span_sql('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')}
  UNION ALL SELECT doc_id, 1, 'ip', start, start + length(m) FROM {span_sql('[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')} WHERE {_IP_PARTS}
  UNION ALL SELECT doc_id, 2, 'card', start, start + length(m) FROM {span_sql('[0-9](?:[ -]?[0-9])+')} WHERE length({digits('m')}) BETWEEN 12 AND 19 AND {luhn(digits('m'))}
  UNION ALL SELECT doc_id, 3, 'phone', start, start + length(m) FROM {span_sql('[+][0-9][ ().0-9-]+[0-9]')} WHERE length({digits('m')}) BETWEEN 9 AND 15"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_matroska, op2_maxent, op3_additive_quantisation, op4_weak_supervision_pii, op5_line_dedup, op6_minhash, op7_toxicity, op8_chat_formatting, op9_packing, op10_sentencepiece, op11_filter_audit, op12_winnowing, op13_alignment, edited_texts, media_payloads, base_scores, base_spans)}
ORACLE_SQL: dict[str, str] = {
    # Every vector of the tables has 64 components; at the oracle's scale the search finds all that are nearest.
    "op3_additive_quantisation": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
fine AS (SELECT vec_id, e, list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b) AS sq FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(range(1, 65), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (sqrt(q.sq) * sqrt(c.sq)) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
refs AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, k, line, last_doc IS NOT NULL AND doc_id < last_doc AS gone FROM keyed LEFT JOIN refs USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_minhash": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
-- Of each set, the rarest elements: two similar sets share one of the first n - ceil(0.8 n) + 1.
items AS (SELECT doc_id, unnest(s) AS e FROM sets),
freq AS (SELECT e, count(*) AS f FROM items GROUP BY e HAVING count(*) > 1),
ranked AS (SELECT i.doc_id, i.e, row_number() OVER (PARTITION BY i.doc_id ORDER BY coalesce(f, 1), i.e) AS k FROM items i LEFT JOIN freq USING (e)),
prefix AS (SELECT r.doc_id, r.e FROM ranked r JOIN sizes z USING (doc_id) WHERE r.k <= z.n - (z.n * 4 + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.e = b.e AND a.doc_id < b.doc_id),
links AS (SELECT c.a, c.b FROM cand c JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT z.doc_id, z.n AS n_shingles, c.component_id, z.doc_id = c.component_id AS kept FROM sizes z JOIN comp c USING (doc_id)""",
    "op8_chat_formatting": """
WITH convs AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM convs),
sized AS (
  SELECT *, CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                      WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END AS fits,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END
    + length(text) + (length(text) - length(replace(text, chr(92), '')))
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '<a>', ''))) // 3 + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
    + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7 + (length(text) - length(replace(text, '[NAME]', ''))) // 6 AS n
  FROM ranked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, min(k) FILTER (WHERE NOT fits) AS violation
FROM sized GROUP BY conv_id""",
    "op11_filter_audit": f"""WITH known AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
  t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  firsts AS (SELECT text, min(doc_id) AS doc_id FROM t GROUP BY text),
  m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
      + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text))::INT + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > f.doc_id, false)::INT AS m
    FROM t JOIN firsts f ON t.text = f.text LEFT JOIN known k ON t.doc_id = k.doc_id),
  c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, m),
  o(filter_order, step, f, p) AS (VALUES {", ".join(f"('{''.join(o)}', {k + 1}, {1 << 'ABCDE'.index(x)}, {sum(1 << 'ABCDE'.index(y) for y in o[:k])})" for o in permutations("ABCDE") for k, x in enumerate(o))})
SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE m & (f | p) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE m & f <> 0 AND m & p = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE m & f <> 0 AND m & p <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE m = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE m & f <> 0 AND m & p = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE m & f <> 0 AND m & p = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (WHERE m & f <> 0), 0)::BIGINT AS shapley FROM c, o GROUP BY part, filter_order, step""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS behind FROM d)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(behind, length(text) // 2)) AS edited_sha256 FROM n""",
    "media_payloads": """SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(t || repeat(' ', (p - n)::BIGINT)) AS payload_sha256 FROM (
  SELECT *, (greatest(1, (n + 191) // 192) * 192)::BIGINT AS p FROM (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT AS n FROM documents))""",
    "base_spans": f"""SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k), '')) AS base_sha256 FROM documents d LEFT JOIN ({_BASE_SPANS}) s USING (doc_id) GROUP BY d.doc_id""",
    "base_scores": f"""WITH w AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} % 10 = 0 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS ws FROM documents),
  t AS (SELECT doc_id, held_out, unnest(ws) AS token FROM w), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
  SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 4)::DOUBLE AS base_score
  FROM t LEFT JOIN c USING (token), n GROUP BY doc_id, held_out""",
}
