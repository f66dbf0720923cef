"""Sequences of tokens: long ones take time by their length, not by its square."""

import random
import time

from pyspark.sql import functions as F

from cloakframe.operators import evaluation, ner


def brute_merged(tokens):
    out, open_ = [], False
    for label, score, start, end in tokens:
        kind = label[2:]
        if label[:2] in ("I-", "L-") and out and open_ and out[-1][2] == kind:
            out[-1][1], open_ = end, label[0] == "I"
            out[-1][3].append(score)
        elif label[:2] in ("B-", "I-", "L-", "U-", "S-"):
            out.append([start, end, kind, [score]])
            open_ = label[0] in "BI"
        else:
            open_ = False
    return [(a, b, ner.LABELS.get(k, k), s) for a, b, k, s in out]


def test_merging_long_sequences(spark):
    rng = random.Random(3)
    few = [[(rng.choice(["B-PER", "I-PER", "I-LOC", "L-PER", "U-ORG", "S-X", "O"]), rng.random(), 5 * k, 5 * k + 4) for k in range(n)] for n in (0, 1, 2, 9, 300)]
    schema = "id int, t array<struct<label:string,score:double,start:int,end:int>>"
    rows = spark.createDataFrame(list(enumerate(few)), schema)
    for how, of in (("mean", lambda s: sum(s) / len(s)), ("max", max), ("min", min)):
        got = {r["id"]: [(s["start"], s["end"], s["label"], s["score"]) for s in r["s"]] for r in rows.select("id", ner.merged("t", how).alias("s")).collect()}
        assert got == {k: [(a, b, x, of(s)) for a, b, x, s in brute_merged(t)] for k, t in enumerate(few)}
    at = time.time()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19999)), lambda k: F.struct(F.lit("U-PER").alias("label"), F.lit(0.5).alias("score"), k.alias("start"), (k + 1).alias("end"))).alias("t"))
    assert long.select(F.size(ner.merged("t"))).first()[0] == 20000 and time.time() - at < 20


def test_words_and_tags_of_long_texts(spark):
    at = time.time()
    rows = spark.range(1).select(F.repeat(F.lit("ab 12 \n"), 20000).alias("text")).withColumn("t", evaluation.tokens("text"))
    t = rows.first()["t"]
    assert len(t) == 40000 and [(x["start"], x["end"], x["m"]) for x in t[-2:]] == [(139993, 139995, "ab"), (139996, 139998, "12")]
    spans = F.expr("transform(sequence(0, 19999), k -> named_struct('start', k * 7 + 3, 'end', k * 7 + 5, 'entity_type', 'N'))")
    tags = rows.withColumn("s", spans).select(evaluation.spans_to_tags("t", "s").alias("tags")).first()["tags"]
    assert tags == ["O", "B-N"] * 20000 and time.time() - at < 60


def test_ids_are_made_on_all_cores_and_without_trials(spark):
    """The customers are one row group; the check digits follow from the others."""
    from cloakframe.functions import validators as v
    from cloakframe.operators import synthetic
    from cloakframe.plans import catalog, engine  # noqa: F401

    assert catalog.QUERIES["synthetic_ids"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
    checks = {"DE": v.steuer_id, "IT": v.codice_fiscale, "NL": v.bsn}
    rows = spark.range(3000).select(*[synthetic.fake("NATIONAL_ID", "id", 7, cc).alias(cc) for cc in checks])
    assert rows.where(" and ".join(f(cc) for cc, f in checks.items())).count() == 3000
    assert all("sequence(0, 99)" not in synthetic.fake_sql("NATIONAL_ID", "id", 7, cc) and "sequence(65, 90)" not in synthetic.fake_sql("NATIONAL_ID", "id", 7, cc) for cc in checks)
    # Bodies that a run or a repetition would end, and one whose first ending asks for a digit of 10.
    from pyspark.sql import functions as F

    for body in ("1234567", "9876543", "1111111", "1000001"):
        made = synthetic.national_id("NL", lambda tag, width, b=body: f"'{b[1:]}'", lambda tag, below, b=body: f"{int(body[0]) - 1}")
        every = [f"{body}{e:02}" for e in range(100)]
        ok = spark.createDataFrame([(x,) for x in every], "x string").where(v.bsn("x")).agg(F.min("x")).first()[0]
        assert spark.range(1).select(F.expr(made)).first()[0] == ok
