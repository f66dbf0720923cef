"""Operators that the catalog's SQL does not reach: sequences, models, files, levels together."""

import json

import pytest
from pyspark.sql import functions as F

from cloakframe.config import AnalysisConfig, analyze
from cloakframe.operators import anonymize as an
from cloakframe.operators import audit, context, metrics, ner, policy, synthetic
from cloakframe.operators import recognizers as r
from cloakframe.session import spread
from cloakframe.sources import files, jsonpatch


def brute_breaker(rows, most, seconds):
    out = {}
    for guard in {g for g, _, _ in rows}:
        times, until = [], -(10**12)
        for _, t, k in sorted(x for x in rows if x[0] == guard):
            if t < until:
                out[k] = "open"
                continue
            times = [x for x in times if x >= t - seconds]
            if len(times) >= most:
                until, out[k] = t + seconds, "tripped"
            else:
                times.append(t)
                out[k] = "allowed"
    return out


def test_breaker(spark):
    rows = [(k % 2, (k * 37) % 400, k) for k in range(120)]
    df = spark.createDataFrame(rows, "guard long, at long, id long")
    got = {x["id"]: x["state"] for x in metrics.breaker(df, "guard", "at", "id", 3, 60).collect()}
    assert got == brute_breaker(rows, 3, 60) and set(got.values()) == {"allowed", "tripped", "open"}
    assert not metrics.breaker(df.where("false"), "guard", "at", "id").count()


def entries(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id % 3 as log", "id", "cast(id as string) as ts", "'u' as actor", "'a' as action", "'e' as endpoint", "'GET' as method", "'r' as request_id", "true as success", "200 as status_code")


def test_chains_go_on_after_a_restart(spark):
    whole = audit.chained(entries(spark, 0, 60), "log", "id")
    first = audit.chained(entries(spark, 0, 30), "log", "id")
    more = audit.chained(entries(spark, 30, 60), "log", "id", audit.heads_of(first, "log", "id"))
    assert sorted(map(tuple, first.unionByName(more).collect())) == sorted(map(tuple, whole.collect()))
    parts = audit.rotated(whole, "log", "id", 500).select("log", "file", F.octet_length("body").alias("n")).collect()
    for log in range(3):
        sizes = {}
        for x in parts:
            if x["log"] == log:
                sizes[x["file"]] = sizes.get(x["file"], 0) + x["n"]
        assert sorted(sizes) == list(range(len(sizes))) and len(sizes) > 2


def test_levels_meet_in_one_analysis(spark):
    df = spark.createDataFrame([(1, "virement IBAN FR7630006000011234567890188 pour Jean Dupont, a@corp.io"), (2, None), (3, "nothing")], "id int, text string")

    def backend(texts):
        return [[(t.index("Jean"), t.index("Jean") + 11, "PERSON", 0.9)] if "Jean" in t else [] for t in texts]

    c = AnalysisConfig(level=3, score_threshold=0.4, trace=True)
    got = {x["id"]: x for x in analyze(df, c, key="id", backend=backend).collect()}
    found = {e["entity_type"]: e for e in got[1]["entities"]}
    assert found["PERSON"]["text"] == "Jean Dupont" and abs(found["PERSON"]["score"] - 0.9) < 1e-9
    # The wrong check digits give 0.45, two words of the context 0.65; weighted 0.45 and 0.30.
    assert abs(found["IBAN"]["score"] - (0.45 * 0.45 + 0.65 * 0.3) / 0.75) < 1e-9
    assert got[2]["entities"] == got[3]["entities"] == [] and len(got[1]["trace"]) >= 3
    with pytest.raises(ValueError):
        analyze(df, c, backend=backend)


def test_metadata(spark):
    df = spark.createDataFrame([("IBAN FR7630006000011234567890189, PESEL 44051401359, card 4532015112830366, +33 612345678, biometric data",)], "text string")
    found = r.detect(df, [*r.DEFAULT_RULES, *r.EU_RULES]).select(F.explode(r.with_metadata("entities")).alias("e")).collect()
    by = {(x["e"]["recognizer"], x["e"]["entity_type"]): {m["key"]: m["value"] for m in x["e"]["metadata"]} for x in found}
    assert by["iban_iso13616", "IBAN"] == {"checksum_ok": "true", "iban_normalized": "FR7630006000011234567890189", "level": "regex"}
    assert by["pl_national_identity", "NATIONAL_ID"]["rule"] == "pl_pesel"
    assert by["credit_card_luhn", "CREDIT_CARD"]["network"] == "visa" and by["eu_phone_phonenumber", "PHONE"]["phone_region"] == "FR"
    assert by["gdpr_art9_keywords", "CUSTOM:GDPR_ART9"]["gdpr_article"] == "9"


def test_registry():
    own = r.Registry().add(r.Rule("ticket", "CUSTOM:TICKET", "T-[0-9]+", 0.9))
    assert "ticket" in own.recognizers() and "ticket" not in own.remove("TICKET").recognizers()
    assert {x.owner for x in r.Registry(r.EU_RULES).get_by_language("pl")} >= {"pl_national_identity", "eu_license_plates"}
    assert "pl_national_identity" not in {x.owner for x in r.Registry(r.EU_RULES).get_by_language("it")}
    assert {x.owner for x in own.get_by_entity("iban")} == {"iban_iso13616"}


def test_lemmas():
    assert context.lemma_of("patients", "fr") == context.lemma_of("patient", "fr")
    assert context.lemma_of("«Employés»,", "fr") == context.lemma_of("employé", "fr")
    assert context.lemma_of("as", "en") == "as" and context.lemma_of("...") == ""


def test_legacy_person_and_combinations(spark):
    kind = "entities array<struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string>>"
    df = spark.createDataFrame([([(8, 12, "PERSON", "Jean", 0.5, "a")],)], kind).withColumn("t", F.lit("Bonjour Jean, la ville de"))
    assert abs(df.select(context.legacy_person("entities", "t", ("bonjour",), ("ville",)).alias("e")).first()["e"][0]["score"] - 0.46) < 1e-9
    three = spark.createDataFrame([([(0, 4, "DATE", "", 0.5, "a"), (50, 54, "DATE", "", 0.5, "a"), (60, 64, "PERSON", "", 0.5, "a"), (66, 70, "ADDRESS", "", 0.96, "a")],)], kind)
    rule = context.Combination(("DATE", "PERSON", "ADDRESS"), 30, 0.2)
    assert [e["score"] for e in three.select(context.combined("entities", rule).alias("e")).first()["e"]] == [0.5, 0.7, 0.7, 0.96]
    none = context.Combination(("DATE", "PERSON"), 30, 0.2, keywords=("femme",))
    assert [e["score"] for e in three.select(context.combined("entities", none, "'x'").alias("e")).first()["e"]] == [0.5, 0.5, 0.5, 0.96]


def test_packs_from_files(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"name": "Own", "regulation": "GDPR", "operators": {"email": "hash"}, "mapping_days": 7}))
    (tmp_path / "hipaa.json").write_text(json.dumps({"audit_days": 1}))
    packs = policy.load_packs(str(tmp_path))
    assert packs["own"][1] == "EMAIL=hash" and packs["hipaa"][3] == 1 and packs["hipaa"][1] == policy.PACKS["hipaa"][1]
    assert policy.merged_config("own", {"language": "fr"}, packs)["entity_retention_days"] == {"EMAIL": 7}
    (tmp_path / "bad.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        policy.load_packs(str(tmp_path))


def test_names_without_a_native_operator_are_errors():
    with pytest.raises(ValueError):
        an.hashed("blake3")
    with pytest.raises(ValueError):
        an.operators_by_policy(policy.pack_operators("pci-dss"))


def test_impact_page_escapes():
    assert "<b>" not in policy.impact_page({"policy": "hipaa", "score": 50, "band": "<b>"}, ["EMAIL", "<b>"])


def test_bodies_changed_in_place(spark):
    masked = lambda t: f"replace({t}, 'Jean', '***')"
    parts = '{ "model" : "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "Jean \\u00e9 [x]"}, {"type": "image", "text": "Jean"}, 3]}, {"content": "[Jean"}, {"content": null}, {"content": 5}], "n": 1.50, "x": {"content": "Jean"}}'
    cases = {
        "messages": [parts, "[]", "no", None, "{}", '{"messages": {"content": "Jean"}}', '{"messages": [{"content": "a", "content": "Jean"}]}', '{"messages": [{"content": ["Jean"]}]}'],
        "prompt": ['{"prompt": "to Jean"}', '{"prompt": ["Jean", 1, "b"], "a": "Jean"}', '{"prompt": 3}'],
        "choices": ['{"choices": [{"message": {"role": "assistant", "content": "Jean!"}, "text": "Jean"}]}'],
        "completions": ['{"choices": [{"text": "Jean\\n"}], "text": "Jean"}'],
    }
    want = {
        "messages": [parts.replace("Jean \\u00e9 [x]", "*** é [x]").replace('"[Jean', '"[***'), None, None, None, "{}", '{"messages": {"content": "Jean"}}', '{"messages": [{"content": "a", "content": "***"}]}', '{"messages": [{"content": ["Jean"]}]}'],
        "prompt": ['{"prompt": "to ***"}', '{"prompt": ["***", 1, "b"], "a": "Jean"}', '{"prompt": 3}'],
        "choices": ['{"choices": [{"message": {"role": "assistant", "content": "***!"}, "text": "Jean"}]}'],
        "completions": ['{"choices": [{"text": "***\\n"}], "text": "Jean"}'],
    }
    for where, bodies in cases.items():
        rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
        got = jsonpatch.with_changed(rows, "body", masked, where).orderBy("k").collect()
        assert [r["body"] for r in got] == want[where]
        same = jsonpatch.with_changed(rows, "body", lambda t: t, where, "again").collect()
        assert all(r["again"] == r["body"] for r in same if r["again"] is not None)


def test_tagged_corpus(spark):
    rows = synthetic.tagged_corpus(spark, 200).collect()
    assert all(len(x["tokens"]) == len(x["ner_tags"]) for x in rows)
    assert {t[:2] for x in rows for t in x["ner_tags"]} == {"O", "B-", "I-"}
    assert sum(any(t.startswith("B-") for t in x["ner_tags"]) for x in rows) == synthetic.corpus(spark, 200).where("entity_type <> 'O'").count()


def test_predictions_of_no_model(spark):
    row = spark.sql("select cast(null as array<struct<start:int,end:int,label:string,score:double>>) as p, array(1D, 3D, 3D) as x").select(ner.adapted("p").alias("p"), ner.softmax_argmax("x").alias("s")).first()
    assert row["p"] == [] and row["s"]["at"] == 1 and 0.4 < row["s"]["p"] < 0.5


def test_small_tables_are_spread_and_others_left(spark, tmp_path, monkeypatch):
    import cloakframe.session as session

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(spread(df)) and plan(spread(spread(df))).count("Repartition") == 1
    assert "Repartition" not in plan(spread(df.groupBy("id").count()))
    monkeypatch.setattr(session, "CORE_BYTES", 1)
    assert "Repartition" not in plan(spread(df))
