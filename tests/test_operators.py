import re
from dataclasses import replace

from pyspark.sql import functions as F

from cloakframe.functions.sqltext import spans
from cloakframe.operators import anonymize as an
from cloakframe.operators import audit, context, evaluation, fusion, metrics, ner, policy, synthetic
from cloakframe.operators import recognizers as r

TEXT = "Contact: jean.dupont@mail.fr or tel +33 6 12 34 56 78, card 4532 0151 1283 0366, ip 10.0.0.1 IBAN FR76 3000 6000 0112 3456 7890 189 BIC BNPAFRPP VAT FR40303265045"


def found(spark, text, rules=None):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(e["entity_type"], e["text"]) for e in r.exploded(r.detect(df, rules), "id").collect()]


def test_default_recognizers(spark):
    got = found(spark, TEXT)
    for want in [("EMAIL", "jean.dupont@mail.fr"), ("PHONE", "+33 6 12 34 56 78"), ("CREDIT_CARD", "4532 0151 1283 0366"), ("IP_ADDRESS", "10.0.0.1"), ("IBAN", "FR76 3000 6000 0112 3456 7890 189"), ("BANK_ACCOUNT", "BNPAFRPP"), ("TAX_ID", "FR40303265045")]:
        assert want in got


def test_eu_recognizers(spark):
    got = found(spark, "PESEL 44051401359 DNI 12345678Z FR AB-123-CD biometric data Steuer-ID 86095742719", r.EU_RULES)
    assert {("NATIONAL_ID", "44051401359"), ("NATIONAL_ID", "12345678Z"), ("VEHICLE_PLATE", "AB-123-CD"), ("CUSTOM:GDPR_ART9", "biometric data"), ("TAX_ID", "86095742719")} <= set(got)


def test_negative_and_odd_texts(spark):
    assert found(spark, None) == found(spark, "") == []
    assert ("EMAIL", "a@example.com") not in found(spark, "write to a@example.com")
    assert not [e for e in found(spark, "card 4532015112830367") if e[0] == "CREDIT_CARD"]
    assert found(spark, "version 1.2.3") == []


def test_long_texts_do_not_break_the_patterns(spark):
    for text in ("a." * 20_000, "1" * 30_000, "a" * 30_000 + "@", "+1 " * 5_000, "FR76" + " 3" * 20_000):
        found(spark, text)


def test_span_positions_match_python(spark):
    text, pattern = "é1 ☃22 𝒳 333 \n4444", "[0-9]+"
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{spans('t', pattern)} as s").first()["s"]
    assert [(s["start"], s["end"], s["m"]) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]


def test_registered_recognizer_and_choice(spark):
    rules = r.register_recognizer([], "ticket", "custom:ticket", "T-[0-9]{4}", 0.9)
    assert found(spark, "see T-1234", rules) == [("CUSTOM:TICKET", "T-1234")]
    assert not r.chosen(rules, disabled=("TICKET",)) and r.chosen(r.DEFAULT_RULES, ["IBAN"])[0].entity == "IBAN"


def ents(spark, rows):
    return spark.createDataFrame([(rows,)], "entities array<struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string>>")


def test_fusion(spark):
    df = ents(spark, [(0, 10, "EMAIL", "x", 0.7, "a"), (1, 10, "EMAIL", "y", 0.9, "b"), (5, 10, "URL", "z", 0.8, "c"), (11, 20, "EMAIL", "w", 0.6, "d")])
    got = df.select(fusion.resolve_overlaps("entities").alias("e")).first()["e"]
    assert [(e["start"], e["end"], e["entity_type"], e["score"], e["recognizer"]) for e in got] == [(0, 10, "EMAIL", 0.9, "b"), (5, 10, "URL", 0.8, "c"), (11, 20, "EMAIL", 0.6, "d")]
    two = ents(spark, [(0, 10, "EMAIL", "x", 0.7, "a"), (11, 20, "EMAIL", "w", 0.6, "d")]).withColumn("t", F.lit("0123456789 abcdefghi"))
    merged = two.select(fusion.merge_adjacent("entities", "t").alias("e")).first()["e"]
    assert [(e["start"], e["end"], e["text"]) for e in merged] == [(0, 20, "0123456789 abcdefghi")]
    kept = df.select(fusion.thresholds("entities", 0.5, {"EMAIL": 0.85}).alias("e")).first()["e"]
    assert [e["recognizer"] for e in kept] == ["b", "c"]
    assert [e["start"] for e in df.select(fusion.longest_only("entities").alias("e")).first()["e"]] == [0, 11]


def test_context(spark):
    df = ents(spark, [(11, 17, "PERSON", "Dupont", 0.5, "a")]).withColumn("t", F.lit("le patient Dupont vient"))
    assert abs(df.select(context.adjusted("entities", "t").alias("e")).first()["e"][0]["score"] - 0.74) < 1e-9
    two = ents(spark, [(0, 4, "DATE", "d", 0.5, "a"), (9, 12, "PERSON", "p", 0.5, "b")])
    rule = context.Combination(("DATE", "PERSON"), 20, 0.2)
    assert [e["score"] for e in two.select(context.combined("entities", rule).alias("e")).first()["e"]] == [0.7, 0.7]
    assert spark.sql(f"select {context.lemma(chr(39) + 'Patients,' + chr(39))} as l").first()["l"] == "patient"


def one(spark, op, text, kind="EMAIL"):
    return spark.createDataFrame([(kind, text)], "k string, t string").select(F.expr(op("k", "t", "'2'")).alias("o")).first()["o"]


def test_anonymize_operators(spark):
    assert one(spark, an.mask(per_word=True), "Jean Dupont") == "J*** D*****"
    assert one(spark, an.mask(4, 4), "FR7630006000011234567890189") == "FR76*******************0189"
    assert one(spark, an.replace(numbered=True), "x") == "<EMAIL_2>" and one(spark, an.redact(), "x") == ""
    assert one(spark, an.hashed(), "x").startswith("sha256:") and len(one(spark, an.hashed("sha512"), "x")) == 23
    assert one(spark, an.pseudonym("s"), "x") == one(spark, an.pseudonym("s"), "x")
    key, nonce = "unhex(repeat('0f', 32))", "unhex(repeat('01', 12))"
    moved = one(spark, an.format_preserving(key, nonce), "a12-9")
    assert len(moved) == 5 and one(spark, an.format_preserving(key, nonce, back=True), moved) == "a12-9"
    sealed = one(spark, an.encrypted(key, "", nonce), "secret")
    assert spark.sql(f"select {an.decrypted(chr(39) + sealed + chr(39), key)} as t").first()["t"] == "secret"


def test_anonymize_and_back(spark):
    df = r.detect(spark.createDataFrame([(TEXT,), (None,), ("",)], "text string"))
    out = an.anonymize(df.withColumn("entities", fusion.longest_only("entities")), {"EMAIL": an.mask(2)})
    rows = out.select("text", "anonymized", an.deanonymize("anonymized.text", "anonymized.transformations").alias("back")).collect()
    assert all(x["back"] == (x["text"] or "") for x in rows)
    first = rows[0]["anonymized"]
    assert all(first["text"][t["final_start"] : t["final_end"]] == t["replacement"] for t in first["transformations"])
    pairs = "array(named_struct('replacement', '<A>', 'original', 'x'), named_struct('replacement', '<A>1', 'original', 'y'))"
    assert spark.sql("select '<A>1 <A>' as a").select(an.restore("a", pairs).alias("o")).first()["o"] == "y x"


def test_policy(spark):
    assert policy.pack_operators("pci-dss")["CREDIT_CARD"] == "fpe"
    risky = spark.sql("select array('IBAN', 'SSN') as a, array('IBAN', 'CREDIT_CARD') as b").select(policy.high_risk(F.col("a")).alias("a"), policy.high_risk(F.col("b")).alias("b")).first()
    assert risky["a"] and not risky["b"]
    assert spark.sql("select ' a\u0001b\nc ' as t").select(policy.minimized(F.col("t"), 4).alias("t")).first()["t"] == "ab"
    rows = spark.sql("select 1 as s, timestamp'2020-01-01' as expires_at union all select 2, null")
    assert [x["s"] for x in policy.unexpired(rows, F.lit("2021-01-01").cast("timestamp")).collect()] == [2]


def test_audit_finds_a_change(spark):
    rows = spark.range(20).selectExpr("id % 2 as log", "id", "cast(id as string) as ts", "'u' as actor", "'a' as action", "'e' as endpoint", "'GET' as method", "'r' as request_id", "true as success", "200 as status_code")
    chain = audit.chained(rows, "log", "id")
    assert [x["broken"] for x in audit.verified(chain, "log", "id").collect()] == [0, 0]
    bent = chain.withColumn("body", F.when(F.col("id") == 6, F.lit("{}")).otherwise(F.col("body")))
    assert sorted(x["broken"] for x in audit.verified(bent, "log", "id").collect()) == [0, 1]


def test_evaluation(spark):
    df = spark.createDataFrame([([(0, 10, "EMAIL"), (20, 30, "IP")], [(1, 10, "EMAIL"), (20, 24, "IP"), (0, 10, "EMAIL")])], "g array<struct<start:int,end:int,entity_type:string>>, p array<struct<start:int,end:int,entity_type:string>>")
    assert df.select(evaluation.matched("g", "p").alias("m")).first()["m"] == [2, -1]
    tags = spark.createDataFrame([(["I-PER", "I-PER", "O", "B-LOC"],)], "tags array<string>").withColumn("tags", evaluation.refined("tags"))
    assert [tuple(s) for s in tags.select(evaluation.tags_to_spans("tags").alias("s")).first()["s"]] == [(0, 2, "PER"), (3, 4, "LOC")]
    assert evaluation.least_hits(10, 75) == 7


def test_ner_gate_and_backend(spark):
    df = ents(spark, [(0, 3, "PERSON", "Ann", 0.6, "a")]).withColumn("id", F.lit(1)).withColumn("text", F.lit("Ann"))
    got = ner.with_backend(df, "id", lambda texts: [[(0, 3, "PERSON", 0.9)] for _ in texts]).first()
    assert got["predictions"][0]["label"] == "PERSON"
    assert not ner.with_backend(df.withColumn("entities", F.expr("filter(entities, e -> false)")), "id", lambda t: [[] for _ in t]).count()


def test_metrics_and_synthetic(spark):
    rows = spark.sql("select * from values (0.001D), (0.3D), (100D), (null) t(v)")
    got = {x["le"]: x["n"] for x in metrics.histogram(rows, F.col("v")).collect()}
    assert got[0.005] == 1 and got[0.5] == 2 and got[60.0] == 2 and got[float("inf")] == 3
    corpus = synthetic.corpus(spark, 50).collect()
    assert all(x["value"] in x["text"] for x in corpus) and corpus == synthetic.corpus(spark, 50).collect()


def test_plates_are_read_once_for_their_signs(spark):
    """Of all signs one pattern is read; look-aheads and gates leave the matches as they are."""
    rules = [x for x in r.EU_RULES if x.entity == "VEHICLE_PLATE"]
    gates = {x.gate for x in rules if x.gate}
    assert len(gates) == 1 and sum(not x.gate for x in rules) == 1
    texts = ["FR AB-123-CD, DE B MW 1234 and IRL 12-D-345", "de la rue", "fr\u00a0AB 123 CD xFR AB-123-CD", "SLO A 12 BC - CZ1A2 3456", "\u017fk AB123CD", "AT W AB 12 NL 12-AB-34 nl ab-12-c3", "", None,
             "call (555) 123-4567 or +33 6 12 34 56 78, 06-12-34-56-78", "a.b+c@x.example.org @a.org a@ b@c -d@e.com", "see www.x.org/a, https://y.de:80 and " + "z" * 63 + ".com " + "z" * 64 + ".com v1.2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [*rules, *[x for x in r.DEFAULT_RULES if x.ahead]]
    assert len(own) == len(rules) + 3
    got, want = (r.detect(docs, some).orderBy("doc_id").select("entities").collect() for some in (own, [replace(x, ahead="", gate="") for x in own]))
    assert got == want and sum(len(row["entities"]) for row in got) >= 10
