import json
from collections import Counter
from math import isclose

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import corpora, layers
from cloakframe.operators.recognizers import DEFAULT_RULES, detect

GRAMMAR = {
    "start": [(1, "{a} and {b}"), (3, "plain"), (1, "{=who} | {=who} {!IBAN} end")],
    "a": [(1, "mail {EMAIL} x"), (2, "to {b}")],
    "b": [(1, "{IP_ADDRESS} é"), (1, "card {CREDIT_CARD} ")],
}


def test_grammar_is_expanded_with_weights():
    flat = corpora.expanded(GRAMMAR)
    assert isclose(sum(w for w, _, _ in flat), 1) and len(flat) == (1 + 2) * 2 + 2
    assert all(len(ts) == len(slots) + 1 for _, ts, slots in flat)
    assert max(flat)[1] == ["plain"]
    for bad in ({"start": [(1, "{start}")]}, {"start": [(1, "{x}")], "x": []}, {"start": [(1, "{x}" * 12)], "x": [(1, "a"), (1, "b")]}):
        with pytest.raises(ValueError):
            corpora.expanded(bad)


def test_alias_table_keeps_shares():
    weights = [5.0, 1.0, 0.5, 3.5, 0.0, 2.0]
    marks = corpora.alias_table(weights)
    got = Counter()
    for k, (mark, other) in enumerate(marks):
        got[k] += mark
        got[other] += corpora.FINE - mark
    for k, w in enumerate(weights):
        assert abs(got[k] / corpora.FINE / len(weights) - w / sum(weights)) < 1e-5


def test_labelled_and_tagged_texts(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").otherwise(F.concat(F.lit("Né "), F.col("id"))).alias("who"), F.lit(1).alias("start"))
    made = corpora.labelled(rows, "id", GRAMMAR, own={"who": ("PERSON", "who")}).cache()
    got = made.collect()
    assert sorted(map(str, got)) == sorted(map(str, corpora.labelled(rows, "id", GRAMMAR, own={"who": ("PERSON", "who")}).collect()))
    kinds = Counter()
    for r in got:
        for s in r["spans"]:
            assert r["text"][s["start"] : s["end"]] == s["text"]
            kinds[s["entity_type"], s["hard"]] += 1
    assert set(kinds) == {("EMAIL", False), ("IP_ADDRESS", False), ("CREDIT_CARD", False), ("IBAN", True), ("PERSON", False)}
    assert 180 < sum(r["text"] == "plain" for r in got) < 300
    found = corpora.found_spans(detect(made, [r for r in DEFAULT_RULES if r.owner in ("email_rfc5322_like", "ipv4", "credit_card_luhn", "iban_iso13616")], threshold=0.6)).collect()
    assert all(r["misled"] == 0 and r["found"] == r["labelled"] - sum(s["entity_type"] == "PERSON" for s in r["spans"]) for r in found)
    for r in corpora.tagged(made).collect():
        assert len(r["tokens"]) == len(r["ner_tags"])
        assert Counter(t[2:] for t in r["ner_tags"] if t[0] == "B") == Counter(s["entity_type"] for s in r["spans"] if not s["hard"])


def test_layers_are_merged_and_checked(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "Own.json").write_text(json.dumps({"entities": {" email ": {"operator": "MASK"}, "PHONE": {"operator": "hash", "score": 1}}, "retention": {"audit_days": 3}, "actions": {"on_violation": ["alert"]}}))
    (b / "x.json").write_text(json.dumps({"name": "own", "entities": {"PHONE": None, "EMAIL": {"score": 0.5}}, "actions": {"on_violation": []}}))
    (b / "hipaa.json").write_text(json.dumps({"entities": {"PERSON": {"operator": "hash"}}}))
    got = layers.load(str(a), str(b))
    assert got["own"] == {"name": "own", "entities": {"EMAIL": {"operator": "mask", "score": 0.5}}, "retention": {"audit_days": 3}, "actions": {"on_violation": []}}
    assert got["hipaa"]["entities"]["PERSON"]["operator"] == "hash" and got["hipaa"]["entities"]["SSN"]["operator"] == "redact"
    assert ("own", "*", "redact") in layers.rows_of(got)
    (b / "y.json").write_text(json.dumps({"entities": {"EMAIL": {"operator": "burn"}, "IBAN": 3}, "retention": {"audit_days": True}, "colour": 1}))
    (b / "z.json").write_text("{")
    with pytest.raises(ValueError) as e:
        layers.load(str(a), str(b))
    for path in ("entities.EMAIL.operator", "entities.IBAN", "retention.audit_days", "colour", "z.json"):
        assert path in str(e.value)


def test_decisions_take_the_version_of_their_time(spark, monkeypatch):
    p = lambda email, other: {"p": {"entities": {"EMAIL": {"operator": email}}, "defaults": {"operator": other}}}
    history = [("2024-01-01", p("mask", "hash")), ("2024-01-02", p("mask", "redact")), ("2024-01-03", {})]
    versions = layers.changes(layers.versions(spark, history))
    assert versions.where("entity_type = 'EMAIL'").count() == 1
    rows = [(1, "p", "EMAIL", "2023-12-31"), (2, "p", "EMAIL", "2024-01-01"), (3, "p", "IP", "2024-01-01"), (4, "p", "IP", "2024-01-02"), (5, "p", "EMAIL", "2024-01-03"), (6, "q", "EMAIL", "2024-01-01"), (7, None, None, None)]
    frame = spark.createDataFrame(rows, "k int, policy string, kind string, at string").withColumn("ts", F.to_timestamp("at"))
    want = {1: "redact", 2: "mask", 3: "hash", 4: "redact", 5: "redact", 6: "redact", 7: "redact"}
    assert {r["k"]: r["operator"] for r in layers.decided(frame, versions, "policy", "kind", "ts").collect()} == want
    monkeypatch.setattr(layers, "MOST_ROWS", 0)
    assert {r["k"]: r["operator"] for r in layers.decided(frame, versions, "policy", "kind", "ts").collect()} == want
