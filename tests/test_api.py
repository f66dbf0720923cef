import json

import pytest

from cloakframe import cli
from cloakframe.config import AnalysisConfig, analyze
from cloakframe.functions.registry import register
from cloakframe.operators import policy
from cloakframe.operators.recognizers import DEFAULT_RULES


def test_config_round_trip_and_errors():
    c = AnalysisConfig(entities=["email"], by_type={"email": 0.9})
    assert AnalysisConfig.load(c.dump()).entities == ["EMAIL"]
    for bad in ('{"nothing": 1}', '{"score_threshold": 2}', '{"entities": ["x"]}'):
        with pytest.raises(ValueError):
            AnalysisConfig.load(bad)


def test_analyze_with_trace(spark):
    df = spark.createDataFrame([("mail a.b@site.fr, version 1.2.3.4",)], "text string")
    r = analyze(df, AnalysisConfig(entities=["EMAIL", "IP_ADDRESS"], trace=True, level=2)).first()
    assert [e["entity_type"] for e in r["entities"]] == ["EMAIL", "IP_ADDRESS"]
    assert all(s["passed"] for t in r["trace"] for s in t["steps"])
    with pytest.raises(ValueError):
        analyze(df, AnalysisConfig(entities=["PERSON"]))


def test_sql_functions(spark):
    names = register(spark, [r for r in DEFAULT_RULES if r.name in ("ipv4", "email_rfc5322_like")])
    assert "pii_luhn" in names
    assert spark.sql("select pii_luhn('79927398713') as ok").first()["ok"]
    got = spark.sql("select d.id, a.text from values (1, 'x 10.0.0.1 y@z.fr'), (2, 'none') d(id, t), lateral pii_analyze(d.t) a order by a.start").collect()
    assert [(r["id"], r["text"]) for r in got] == [(1, "10.0.0.1"), (1, "y@z.fr")]


def test_impact_report(spark):
    rows = policy.impact_scores(spark, policy.operator_dimension(spark).select("policy", "entity_type")).collect()
    text = policy.impact_report(next(r.asDict() for r in rows if r["policy"] == "hipaa"), ["EMAIL"])
    assert "hipaa" in text and "| EMAIL | 8 |" in text


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("see 10.1.2.3 now")
    assert cli.main(["scan", str(tmp_path)]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["text"] == "10.1.2.3"
    assert cli.main(["analyze", "nothing here"]) == 0
    assert cli.main(["anonymize", "to a.b@site.fr"]) == 0 and "a." in capsys.readouterr().out
    path = str(tmp_path / "c.json")
    assert cli.main(["config", "init", path]) == 0 and cli.main(["config", "validate", path]) == 0
