"""Queries of dictionaries, numbering plans, carried state, histograms and bodies changed in place; they join those of ``catalog``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbering
from ..operators import corpora, layers, literals, metrics
from ..operators.recognizers import DEFAULT_RULES, detect
from ..sources import jsonpatch
from ..streaming import ledger, streams
from .catalog import docs_of, kept, query, shared_path, table
from .engine import GUARDED_SQL
from .oracles import PLAN_VALUES

_DICTIONARY = """(SELECT lower(w) AS w, min(i) AS i FROM (
    SELECT unnest(ws) AS w, item_id * 10000 + generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS ws FROM benchmark) UNION ALL SELECT p_name, 1000000000 + p_partkey FROM part UNION ALL SELECT c_name, 2000000000 + c_custkey FROM customer) GROUP BY lower(w))"""


@query(f"""SELECT w AS literal, i AS literal_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT string_agg(regexp_escape(w), '|' ORDER BY length(w) DESC, w) FROM {_DICTIONARY}))) AS w FROM documents) JOIN {_DICTIONARY} USING (w) GROUP BY w, i""")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark, names of parts and customers, found in all documents in one pass."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("k", "w")).select("w", (F.col("item_id") * 10_000 + F.col("k") + 1).alias("i"))
    names = [table(spark, sf_dir, t).select(F.col(w).alias("w"), (F.lit(base) + F.col(k)).alias("i")) for t, w, k, base in (("part", "p_name", "p_partkey", 10**9), ("customer", "c_name", "c_custkey", 2 * 10**9))]
    own = words.unionByName(names[0]).unionByName(names[1]).groupBy(F.lower("w").alias("w")).agg(F.min("i").alias("i"))
    found = literals.find(docs_of(spark, sf_dir), own, "w", "i")
    counts = found.groupBy("literal_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return counts.join(F.broadcast(own), counts["literal_id"] == own["i"]).select(F.col("w").alias("literal"), "literal_id", "n", "docs")


# Numbers of each plan's beginnings, one digit short to one long, from the keys of a table.
_PLANS = numbering.plan_rows()
_PICK = f"SELECT c_custkey, prefix, region AS r, least, most FROM customer JOIN (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {PLAN_VALUES}) p(prefix, region, kind, least, most)) ON k = c_custkey % {len(_PLANS)}"
_CODES = " ".join(f"WHEN '{k}' THEN {len(str(c))}" for k, c in numbering.CALLING.items())
_MADE = f"""SELECT c_custkey, prefix || substring('7203914586' || '3141592653', 1 + (c_custkey % 5)::INT, greatest(least + c_custkey // {len(_PLANS)} % 4 - 1 + (CASE r {_CODES} END) - length(prefix), 0)::INT) AS d FROM ({_PICK})"""


@query(f"""WITH n AS ({_MADE}), p AS (SELECT * FROM (VALUES {PLAN_VALUES}) p(prefix, region, kind, least, most))
SELECT c_custkey, arg_max(region, length(prefix)) AS region, substring(d, 1 + arg_max(CASE region {_CODES} END, length(prefix))::INT) AS national, arg_max(kind, length(prefix)) AS line_type,
  arg_max(length(d) - (CASE region {_CODES} END) BETWEEN least AND most, length(prefix)) AS valid FROM n JOIN p ON starts_with(d, prefix) GROUP BY c_custkey, d""")
def phone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, national number, line type and validity of numbers made from the keys of customers, some too short or long."""
    at = F.element_at(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(n - 1 + len(str(numbering.CALLING[r])) - len(p)).alias("more")) for p, r, _, n, _ in _PLANS]), (F.col("c_custkey") % len(_PLANS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", at.alias("p"))
    size = F.greatest(F.col("p.more") + F.expr(f"c_custkey div {len(_PLANS)} % 4"), F.lit(0)).cast("int")
    made = F.concat(F.lit("+"), "p.prefix", F.substring(F.lit("72039145863141592653"), (1 + F.col("c_custkey") % 5).cast("int"), size))
    return rows.select("c_custkey", made.alias("d")).select("c_custkey", F.expr(numbering.number("d")).alias("x")).where("x is not null").select("c_custkey", "x.*")


def _in_parts(rows: DataFrame, order: str, parts: int = 4) -> str:
    """A folder of Parquet files that hold the rows by ranges of a whole number, each written after the one before it."""
    path = shared_path(rows.sparkSession)
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    for k in range(parts):
        step = ((hi or 0) - (lo or 0)) // parts + 1
        rows.where((F.col(order) >= (lo or 0) + k * step) & (F.col(order) < (lo or 0) + (k + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return path


#: Rows of a stream's file, and so of a micro-batch.
FILE_ROWS = 1 << 18


def _in_order(rows: DataFrame, *order: str, most: int = FILE_ROWS, least: int = 3) -> str:
    """A folder of Parquet files that hold the rows by ranges of ``order``, each of about ``most`` rows and written after the one before it.

    The ranges are cut in one pass and then copied file by file, so that a row is written twice however many there are.
    """
    spark = rows.sparkSession
    path, ranges = shared_path(spark), shared_path(spark)
    rows.repartitionByRange(max(least, -(-rows.count() // most)), *order).write.parquet(ranges)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ranges)
    found = [x.getPath() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    for file in sorted((x for x in found if x.getName().endswith(".parquet")), key=lambda x: x.getName()):
        spark.read.schema(rows.schema).parquet(file.toString()).coalesce(1).write.mode("append").parquet(path)
    return path


LEDGER_FIELDS = ["actor", "action", "request_id"]


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 8 AS log, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS k,
    '{"actor":"' || user_id || '","action":"' || event_type || '","request_id":"' || event_id || '"}' AS body FROM events),
  c AS (SELECT event_id, log, k, body, '' AS prev_hash, sha256('|' || body) AS entry_hash, 0::BIGINT AS bytes FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.log, e.k, e.body, c.entry_hash, sha256(c.entry_hash || '|' || e.body), c.bytes + strlen(c.body) FROM c JOIN e ON e.log = c.log AND e.k = c.k + 1)
SELECT event_id, log::VARCHAR AS log, k - 1 AS number, bytes // 20000 AS file, prev_hash, entry_hash FROM c""")
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit entries that come in a stream, which is stopped half way and taken up again: the chains of one run."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("log"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("request_id"))
    path, root, checkpoint = _in_parts(rows, "event_id"), shared_path(spark), shared_path(spark)
    half = files_until(spark, path, 2)
    book = ledger.Ledger(spark, root, "log", "event_id", LEDGER_FIELDS, 20_000)
    for where in (half, path):
        book.run(streams.read_rows(spark, where, rows.schema.simpleString()[7:-1].replace(":", " "), 1), checkpoint)
    return book.entries().select("event_id", "log", "number", "file", "prev_hash", "entry_hash")


def files_until(spark: SparkSession, path: str, files_: int) -> str:
    """A pattern of the first files of a folder, by the time they were written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [x for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where) if x.getPath().getName().endswith(".parquet")]
    names = [x.getPath().getName() for x in sorted(found, key=lambda x: x.getModificationTime())][:files_]
    return f"{path}/{{{','.join(names)}}}"


@query(f"""{GUARDED_SQL} s(g, k, tm, event_id, outcome, times, until, trial) AS (
  SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, -1::BIGINT, '', []::BIGINT[], 0::BIGINT, false FROM r UNION ALL
  SELECT g, k, tm, event_id, outcome, CASE outcome WHEN 'open' THEN times WHEN 'tripped' THEN live ELSE list_append(live, tm) END, CASE outcome WHEN 'tripped' THEN tm + 1800 ELSE until END, outcome IN ('open', 'tripped') FROM (
    SELECT *, CASE WHEN tm < until THEN 'open' WHEN len(live) >= 4 THEN 'tripped' WHEN trial THEN 'half_open' ELSE 'allowed' END AS outcome FROM (
      SELECT r.g, r.k, r.tm, r.event_id, s.times, s.until, s.trial, list_filter(s.times, lambda x: x > r.tm - 3600) AS live FROM s JOIN r ON r.g = s.g AND r.k = s.k + 1)))
SELECT g::VARCHAR AS "key", tm AS "at", event_id AS number, outcome FROM s WHERE k > 0""")
def streamed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of four guards judged on a stream in order of time, over micro-batches of bounded size; a row of a later time moves the watermark past them all.

    None comes behind the watermark, and what waits in a guard's state is a micro-batch and its last ten minutes.
    """
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("guard"), "ts", "event_id")
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("guard"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(1 << 40).cast("long").alias("event_id"))
    path = _in_order(rows, "ts", "event_id")
    end.coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_rows(spark, path, "guard long, ts timestamp, event_id long", 1)
    return streams.run_to_files(streams.guard(stream, "guard", "ts", "event_id", 3600, 4, 1800), shared_path(spark), shared_path(spark))


BOUNDS = (5.0, 10.0, 20.0, 40.0, 80.0)
_PLACE = "CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_QUANTILE = f"""SELECT window_start, event_type, CASE WHEN k >= {len(BOUNDS)} THEN {BOUNDS[-1]}::DOUBLE ELSE lo + (hi - lo) * (0.9::DOUBLE * n - below) / own END AS p FROM (
  SELECT *, CASE k WHEN 0 THEN 0 ELSE [{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}][k::INT] END AS lo, [{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}][k::INT + 1] AS hi,
    row_number() OVER (PARTITION BY window_start, event_type ORDER BY k) AS nth FROM (
    SELECT *, sum(own) OVER w AS upto, sum(own) OVER w - own AS below, sum(own) OVER (PARTITION BY window_start, event_type) AS n FROM (
      SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, {_PLACE} AS k, count(*) AS own FROM events WHERE value IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY window_start, event_type ORDER BY k))
  WHERE upto >= 0.9::DOUBLE * n) WHERE nth = 1"""


@query(f"SELECT window_start, event_type, round(p, 6) AS p FROM ({_QUANTILE}) WHERE p > 30")
def bucket_quantile_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.bucket_counts(table(spark, sf_dir, "events"), "ts", F.col("value"), BOUNDS, "6 hours", ("event_type",))
    return metrics.quantile_alerts(counts, 0.9, 30.0, BOUNDS).select("window_start", "event_type", F.round("p", 6).alias("p"))


@query(f"""SELECT window_start, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, [{', '.join(f'count(*) FILTER (WHERE {_PLACE} = {k})' for k in range(len(BOUNDS) + 1))}] AS n FROM events WHERE value IS NOT NULL GROUP BY 1)""".replace("window_start, n FROM (", "window_start, array_to_string(n, ',') AS n FROM ("))
def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of six hours and event types added up to those of days."""
    counts = metrics.bucket_counts(table(spark, sf_dir, "events"), "ts", F.col("value"), BOUNDS, "6 hours", ("event_type",))
    days = metrics.merged_buckets(counts.withColumn("window_start", F.date_trunc("day", "window_start")), "window_start")
    return days.select("window_start", F.array_join(F.col("own").cast("array<string>"), ",").alias("n"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, series, sum(CASE WHEN before IS NULL THEN 0 WHEN n < before THEN n ELSE n - before END)::BIGINT AS increase FROM (
  SELECT *, lag(n) OVER (PARTITION BY series ORDER BY ts, n) AS before FROM (
    SELECT user_id % 8 AS series, ts, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) * 3 % 50 AS n FROM events)) GROUP BY 1, 2""")
def counter_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of counters that begin anew after some fifty."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("series").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("series"), "ts", "event_id").select("series", "ts", (nth * 3 % 50).cast("long").alias("n"))
    return metrics.counter_increases(rows, "ts", "n", ("series",), "6 hours")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as request bodies with fields that no reader of texts knows; every other one has a list as its content."""
    text = F.coalesce("text", F.lit(""))
    listed = F.to_json(F.struct(F.lit("m-1").alias("model"), F.array(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x 1").alias("text"))).alias("content"))).alias("messages"), F.struct(F.lit(1.5).alias("t")).alias("tools")))
    plain = F.to_json(F.struct(F.array(F.struct("role", text.alias("content"), F.lit(7).alias("weight"))).alias("messages"), F.lit("m 1").alias("model")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.when(F.col("turn") % 2 == 0, listed).otherwise(plain).alias("body"))


@query("""SELECT conv_id, turn, sha256(regexp_replace(coalesce(text, ''), '[0-9]', '#', 'g')) AS text_sha256, CASE turn % 2 WHEN 0 THEN 'm-1' ELSE 'm 1' END AS model,
  CASE turn % 2 WHEN 0 THEN '{"t":1.5}' ELSE '7' END AS rest, CASE turn % 2 WHEN 0 THEN 'x 1' END AS other, true AS same FROM conversations""")
def chat_bodies_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts changed inside whole bodies: fields that are no texts stay, and the identity gives the body back."""
    rows = _bodies(spark, sf_dir)
    rows = jsonpatch.with_changed(rows, "body", lambda t: f"regexp_replace({t}, '[0-9]', '#')", out="new")
    rows = jsonpatch.with_changed(rows, "body", lambda t: t, out="again")
    of = lambda path: F.get_json_object("new", path)
    even = F.col("turn") % 2 == 0
    text = F.when(even, of("$.messages[0].content[0].text")).otherwise(of("$.messages[0].content"))
    return rows.select("conv_id", "turn", F.sha2(text, 256).alias("text_sha256"), of("$.model").alias("model"), F.when(even, of("$.tools")).otherwise(of("$.messages[0].weight")).alias("rest"), F.when(even, of("$.messages[0].content[1].text")).alias("other"), (F.col("again") == F.col("body")).alias("same"))


@query("SELECT event_id, event_type FROM events ORDER BY event_type NULLS FIRST, event_id LIMIT 50 OFFSET 150")
def audit_fourth_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages, each found from the token of the one before it."""
    rows, token, page = table(spark, sf_dir, "events").select("event_id", "event_type"), None, None
    for _ in range(4):
        page = metrics.page_after(rows, ["event_type", "event_id"], token, 50)
        last = page.orderBy(F.desc("event_type"), F.desc("event_id")).select("token").first()
        token = last["token"] if last else token
    return page.drop("token")


@query("""SELECT event_id, event_id || ',' || CASE event_id % 4 WHEN 0 THEN '''=' || event_type WHEN 1 THEN '"a ""' || event_type || '"", b"' WHEN 2 THEN '''-1+2' ELSE event_type END || ',' AS line FROM events""")
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as lines of CSV; some cells would be formulas, some hold quotes."""
    cell = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("="), "event_type")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('a "'), "event_type", F.lit('", b'))).when(F.col("event_id") % 4 == 2, "-1+2").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", cell.alias("cell"), F.lit(None).cast("string").alias("none")).select("event_id", metrics.csv_line(["event_id", "cell", "none"]).alias("line"))


PLACEHOLDERS = {"<PERSON_1>": "la", "<PERSON_12>": "en", "[[MAIL:3]]": "de"}


def _masked(text: str | Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("la"), F.lit("<PERSON_1>"))
    return F.replace(F.replace(out, F.lit("de"), F.lit("[[MAIL:3]]")), F.lit("en"), F.lit("<PERSON_12>"))


@query("""SELECT conv_id, count(*) AS turns, (sum(length(replace(replace(replace(coalesce(text, ''), 'la', '<PERSON_1>'), 'de', '[[MAIL:3]]'), 'en', '<PERSON_12>'))))::BIGINT AS masked_chars,
  sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id""")
def restored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked turns cut into chunks of 48 characters, the odd chunks sent first, restored on a stream and put together."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _masked("text").alias("masked"))
    size = F.expr("greatest((length(masked) - 1) div 48, 0)")
    chunks = rows.select(F.concat_ws("/", "conv_id", "turn").alias("answer"), "masked", F.explode(F.sequence(F.lit(0), size.cast("int"))).alias("number"), size.alias("most"))
    chunks = kept(chunks.select("answer", "number", F.expr("substring(masked, number * 48 + 1, 48)").alias("chunk"), (F.col("number") == F.col("most")).alias("last")))
    path = shared_path(spark)
    for odd in (1, 0):
        chunks.where(F.col("number") % 2 == odd).coalesce(2).write.mode("append").parquet(path)
    stream = streams.read_rows(spark, path, "answer string, number int, chunk string, last boolean", 2)
    # Some 200 answers to a key of the state, however many there are.
    stream = streams.restored(stream, PLACEHOLDERS, groups=max(64, rows.count() // 200))
    out = streams.run_to_files(stream, shared_path(spark), shared_path(spark))
    whole = out.groupBy("answer").agg(F.expr("array_join(transform(array_sort(collect_list(struct(number, text))), x -> x.text), '')").alias("text"))
    whole = whole.select(F.split("answer", "/").alias("at"), "text").select(F.col("at")[0].cast("long").alias("conv_id"), F.col("at")[1].cast("int").alias("turn"), "text")
    both = whole.join(rows.select("conv_id", F.col("turn").cast("int").alias("turn"), F.length("masked").alias("n")), ["conv_id", "turn"])
    done = both.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("masked_chars"), F.expr("array_sort(collect_list(struct(turn, text)))").alias("xs"))
    return done.select("conv_id", "turns", "masked_chars", F.sha2(F.array_join(F.transform("xs", lambda x: x["text"]), "\n"), 256).alias("text_sha256"))


GRAMMAR = {
    "start": [(3, "{opening} {fact}"), (2, "{opening} {fact} ; {fact}"), (1, "Nothing to report today")],
    "opening": [(2, "Dear {=customer},"), (1, "Note:"), (1, "File of {=customer}:")],
    "fact": [(3, "write to {EMAIL} please"), (2, "{money}"), (2, "the host is {IP_ADDRESS} now"), (1, "reference {!CREDIT_CARD} is void")],
    "money": [(2, "pay to {IBAN} soon"), (1, "card {CREDIT_CARD} was used"), (1, "not {!IBAN} any more")],
}
OWN_VALUES = {"customer": ("CUSTOM:CUSTOMER", "c_name")}
_FLAT = corpora.expanded(GRAMMAR)
_ALIAS = corpora.alias_table([w for w, _, _ in _FLAT])
#: Kinds of spans that the searched rules find; a row's own name is not among them.
_SOUGHT = [[s for s in slots if s[0] not in "!="] for _, _, slots in _FLAT]


def drawn(key: str) -> Callable[[str, int], str]:
    """Numbers of a key that other engines can draw too."""
    return lambda tag, below: f"({key} * 48271 + {len(tag) * 1009}) % 2147483647 % {below}"


@query(f"""WITH t AS (SELECT c_custkey, (c_custkey * 48271 + {len('template') * 1009}) % 2147483647 % {len(_FLAT)} AS k, (c_custkey * 48271 + {len('share') * 1009}) % 2147483647 % {corpora.FINE} AS u FROM customer),
  a(k, mark, other) AS (VALUES {', '.join(str((k, *x)) for k, x in enumerate(_ALIAS))}), s(k, labelled, hard) AS (VALUES {', '.join(str((k, len(_SOUGHT[k]), sum(x[0] == '!' for x in slots))) for k, (_, _, slots) in enumerate(_FLAT))})
SELECT c_custkey, s.labelled, s.labelled AS found, s.hard, 0 AS misled FROM t JOIN a ON a.k = t.k JOIN s ON s.k = CASE WHEN u < mark THEN t.k ELSE other END""")
def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made from customers by a grammar: every labelled span is found where it stands, no near miss is taken for a value."""
    made = corpora.labelled(table(spark, sf_dir, "customer"), "c_custkey", GRAMMAR, own=OWN_VALUES, draw=drawn("c_custkey"))
    made = made.withColumn("spans", F.filter("spans", lambda x: x["entity_type"] != "CUSTOM:CUSTOMER"))
    rules = [x for x in DEFAULT_RULES if x.name in ("email_rfc5322_like", "iban_iso13616", "credit_card_luhn", "ipv4")]
    found = corpora.found_spans(detect(made, rules, threshold=0.6))
    return found.select("c_custkey", "labelled", "found", F.expr("size(filter(spans, s -> s.hard))").alias("hard"), "misled")


@query(f"""WITH t AS (SELECT s_suppkey, (s_suppkey * 48271 + {len('template') * 1009}) % 2147483647 % {len(_FLAT)} AS k, (s_suppkey * 48271 + {len('share') * 1009}) % 2147483647 % {corpora.FINE} AS u FROM supplier),
  a(k, mark, other) AS (VALUES {', '.join(str((k, *x)) for k, x in enumerate(_ALIAS))}), s(k, n, named) AS (VALUES {', '.join(str((k, sum(x[0] != '!' for x in slots), sum(x[0] == '=' for x in slots))) for k, (_, _, slots) in enumerate(_FLAT))})
SELECT s_suppkey, s.n AS begins, s.named AS names FROM t JOIN a ON a.k = t.k JOIN s ON s.k = CASE WHEN u < mark THEN t.k ELSE other END""")
def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made from suppliers as words with tags: one beginning for each span, near misses untagged."""
    made = corpora.labelled(table(spark, sf_dir, "supplier"), "s_suppkey", GRAMMAR, own={"customer": ("ORGANIZATION", "s_name")}, draw=drawn("s_suppkey"))
    tags = corpora.tagged(made)
    count = lambda like: F.expr(f"size(filter(ner_tags, t -> t like '{like}'))")
    return tags.select("s_suppkey", count("B-%").alias("begins"), count("B-ORG%").alias("names"))


#: Three states of two policies; in the second, one type changes and one goes, in the third one policy is gone.
HISTORY = [
    ("2024-01-01 00:00:00", {"base": {"entities": {"CLICK": {"operator": "mask"}, "ERROR": {"operator": "hash"}}, "defaults": {"operator": "replace"}}, "side": {"entities": {"CLICK": {"operator": "redact"}}}}),
    ("2024-01-05 00:00:00", {"base": {"entities": {"CLICK": {"operator": "fpe"}}, "defaults": {"operator": "replace"}}, "side": {"entities": {"CLICK": {"operator": "redact"}}}}),
    ("2024-01-09 12:00:00", {"base": {"entities": {"CLICK": {"operator": "fpe"}}, "defaults": {"operator": "mask"}}}),
]
_VERSIONS = ", ".join(f"({p!r}, {t!r}, {o!r}, TIMESTAMP '{at}', {'NULL' if k + 1 == len(HISTORY) else repr(HISTORY[k + 1][0])}::TIMESTAMP)" for k, (at, ps) in enumerate(HISTORY) for p, t, o in layers.rows_of(ps))


@query(f"""WITH v(policy, entity_type, op, valid_from, valid_to) AS (VALUES {_VERSIONS}), e AS (SELECT event_id, ts, upper(event_type) AS entity_type, CASE user_id % 3 WHEN 0 THEN 'side' ELSE 'base' END AS policy FROM events)
SELECT e.policy, e.entity_type, coalesce(a.op, b.op, 'redact') AS operator, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e
  LEFT JOIN v a ON a.policy = e.policy AND a.entity_type = e.entity_type AND e.ts >= a.valid_from AND (a.valid_to IS NULL OR e.ts < a.valid_to)
  LEFT JOIN v b ON b.policy = e.policy AND b.entity_type = '*' AND e.ts >= b.valid_from AND (b.valid_to IS NULL OR e.ts < b.valid_to) GROUP BY 1, 2, 3""")
def decisions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events decided by the version of their policy that held at their time."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.upper("event_type").alias("entity_type"), F.when(F.col("user_id") % 3 == 0, "side").otherwise("base").alias("policy"))
    out = layers.decided(rows, layers.changes(layers.versions(spark, HISTORY)), "policy", "entity_type", "ts")
    return out.groupBy("policy", "entity_type", "operator").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
