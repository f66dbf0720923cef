import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import numbering
from cloakframe.operators import literals, metrics
from cloakframe.operators.recognizers import DEFAULT_RULES, detect, exploded


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leftmost(text, pairs):
    """(start, end, id) of the leftmost longest literals, tried at each place."""
    own = {}
    for i, w in pairs:
        if i is not None and w:
            own[fold(w)] = min(i, own.get(fold(w), i))
    words, t, out, at = sorted(own, key=len, reverse=True), fold(text or ""), [], 0
    while at < len(t):
        hit = next((w for w in words if t.startswith(w, at)), None)
        if hit:
            out.append((at, at + len(hit), own[hit]))
        at += len(hit) if hit else 1
    return out


def test_literals_of_large_dictionaries_that_no_text_holds_are_not_compiled(spark, monkeypatch):
    """All that stand in a text are found, across batches too; a trie is made of few others, in as few tables as its states fill."""
    compiled, sizes = literals.compiled, []
    monkeypatch.setattr(literals, "compiled", lambda own: (sizes.append(len(own)), compiled(own))[1])
    monkeypatch.setattr(literals, "SMALL", 1000)
    monkeypatch.setattr(literals, "BATCH", 100)
    pairs = [(k, f"Customer#{k:09d}") for k in range(2000)] + [(5000, "de"), (5001, "Exactly8"), (5002, "é🙂 and a longer one")]
    docs = [(k, f"de cUSTOMER#{k * 7:09d}x é🙂 and a longer one, exactly8") for k in range(3)] + [(3, None), (4, "Customer#"), (5, "exactly")]
    got = literals.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(pairs, "i long, w string"), "w", "i").collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["literal_id"]) for r in got) == sorted((k, *m) for k, t in docs for m in leftmost(t, pairs))
    assert len(got) == 12 and sum(sizes) < 30
    assert len(literals.tables(pairs[:2000], 20_000 * 20)) <= 2


@pytest.mark.parametrize("entries", [1 << 24, 60])
def test_literals_equal_a_search_at_each_place(spark, monkeypatch, entries):
    monkeypatch.setattr(literals, "LANE", 16)
    monkeypatch.setattr(literals, "BATCH", 300)
    rng = random.Random(12)
    pairs = [(k, "".join(rng.choice("abAé🙂 ") for _ in range(rng.randint(1, 7)))) for k in range(25)] + [(30, ""), (31, None), (3, "AB"), (40, "x" * 60)]
    docs = [(k, "".join(rng.choice("abcBé🙂 ") for _ in range(rng.randint(0, 200))), 0) for k in range(40)] + [(40, None, 0), (41, "", 0), (42, "x" * 500, 0), (42, "x" * 500, 0)]
    got = literals.find(spark.createDataFrame(docs, "doc_id long, text string, start int"), spark.createDataFrame(pairs, "i long, w string"), "w", "i", entries=entries).collect()
    want = [(k, *m) for k, t, _ in docs for m in leftmost(t, pairs)]
    assert sorted((r["doc_id"], r["start"], r["end"], r["literal_id"]) for r in got) == sorted(want)
    none = spark.createDataFrame([], "i long, w string")
    assert not literals.find(spark.createDataFrame(docs, "doc_id long, text string, start int"), none, "w", "i").count()


def test_tables_hold_all_literals_within_their_size():
    rng = random.Random(1)
    words = [(k, "".join(rng.choice("abcdef") for _ in range(8))) for k in range(300)]
    own = literals.tables(words, 2000)
    assert len(own) > 5 and sorted(i for t in own for i in t.ids.tolist()) == list(range(300))
    assert all(len(t.step) <= 2000 for t in own)


def test_numbers_of_plans(spark):
    cases = {
        "+33 1 42 68 53 00": ("FR", "142685300", "fixed_line", True), "+49 (0)30 901820": ("DE", "30901820", "fixed_line", True), "0033 6 12 34 56 78": ("FR", "612345678", "mobile", True),
        "+31 20 794 0000 1": ("NL", "2079400001", "fixed_line", False), "+420 999 123 456": ("CZ", "999123456", "unknown", False), "+39 06 6982": ("IT", "066982", "fixed_line", True),
        "+353 1800 123 456": ("IE", "1800123456", "toll_free", True), "+44 20 7946 0958": None, "0612345678": None, "": None, None: None, "+": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", F.expr(numbering.number("s")).alias("x"), F.expr(numbering.valid("s")).alias("ok")).collect()
    assert {r["s"]: r["x"] and tuple(r["x"]) for r in rows} == cases
    assert all(r["ok"] == bool(cases[r["s"]] and cases[r["s"]][3]) for r in rows)


def test_a_pattern_is_searched_once(spark, tmp_path):
    """Exploding what is found does not find it again."""
    spark.createDataFrame([(1, "at 10.0.0.1")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = exploded(detect(spark.read.parquet(str(tmp_path / "d")), [r for r in DEFAULT_RULES if r.name == "ipv4"]), "doc_id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(__text") == 1
    assert found.count() == 1


def test_bucket_quantiles(spark):
    bounds = (1.0, 2.0, 4.0)
    rows = spark.createDataFrame([([0, 0, 0, 0],), ([10, 0, 0, 0],), ([0, 4, 4, 0],), ([0, 0, 0, 5],), ([1, 1, 1, 1],)], "own array<long>")
    got = [r["p"] for r in rows.select(metrics.bucket_quantile("own", 0.5, bounds).alias("p")).collect()]
    assert got == [None, 0.5, 2.0, 4.0, 2.0]
    values = [0.5, 1.0, 1.5, 3.0, 9.0, None]
    frame = spark.createDataFrame([(60 * k, v) for k, v in enumerate(values)], "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v")
    counts = metrics.bucket_counts(frame, "ts", F.col("v"), bounds, "2 minutes")
    assert [r["own"] for r in counts.orderBy("window_start").collect()] == [[2, 0, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]]
    assert metrics.merged_buckets(counts.withColumn("a", F.lit(1)), "a").first()["own"] == [2, 1, 1, 1]


def test_counters_that_begin_anew(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 10, 9), ("a", 20, 2), ("a", 70, 3), ("b", 0, 1), ("b", 80, None)], "k string, s long, n long").select("k", F.timestamp_seconds("s").alias("ts"), "n")
    got = metrics.counter_increases(rows, "ts", "n", ("k",), "1 minute").collect()
    assert sorted((r["k"], r["window_start"].minute, r["increase"]) for r in got) == [("a", 0, 6), ("a", 1, 1), ("b", 0, 0)]


def test_lasting_alerts(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 60, 120, 240, 300, 480)], "s long").select(F.timestamp_seconds("s").alias("window_start"))
    assert [int(r["window_start"].timestamp()) for r in metrics.lasting(rows, 2, 60).orderBy("window_start").collect()] == [60, 120, 300]


def test_pages_and_csv(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", 'q"', "é"]), k) for k in range(25)]
    frame = spark.createDataFrame(rows, "w string, k long")
    token, seen = None, []
    while page := metrics.page_after(frame, ["w", "k"], token, 7).collect():
        seen += [(r["w"], r["k"]) for r in page]
        token = page[-1]["token"]
    assert seen == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    for bad in ("x", metrics.page_after(frame, ["k"]).first()["token"]):
        with pytest.raises(ValueError):
            metrics.page_after(frame, ["w", "k"], bad)
    cells = spark.createDataFrame([("=1+1", 'a "b"', None), ("@x", "a,b", "-2"), ("ok", "\tz", "l\nm")], "a string, b string, c string")
    assert [r["x"] for r in cells.select(metrics.csv_line(["a", "b", "c"]).alias("x")).collect()] == ["'=1+1,\"a \"\"b\"\"\",", "'@x,\"a,b\",'-2", "ok,'\tz,\"l\nm\""]
