import os

import pytest

import corpus_pipeline
from cloakframe.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.reject_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns
    bad = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0")
    assert kept.join(bad, "doc_id", "left_semi").count() >= 0.97 * docs.join(bad, "doc_id", "left_semi").count()
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, DATA)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    one = corpus_pipeline.keep_one_of_near_copies(spark, docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")), DATA)
    assert one.where("doc_id >= 100000").count() == 0
    assert corpus_pipeline.mask_personal_data(spark, docs, DATA).where("text rlike '@[a-z0-9]+[.]example'").count() == 0
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.mask_personal_data):
        assert stage(spark, docs.where("false"), DATA).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_queries_equal_their_sql(spark):
    """The queries with SQL, on the smallest tables; the driver does the same on larger ones."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name in ("media_payloads", "base_scores", "base_spans", "op5_line_dedup", "op8_chat_formatting"):
        df = queries.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        shown = lambda rows: sorted(repr([round(x, 3) if isinstance(x, float) else x for x in r]) for r in rows)
        got = shown([[r[c] for c in columns] for r in df.collect()])
        res = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in res.description]
        assert got == shown([[dict(zip(names, r, strict=True))[c] for c in columns] for r in res.fetchall()]), name


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def small_corpus():
    """Rows (doc_id, text): clean texts, copies, near copies, one doc_id with two texts, repeated lines and personal data."""
    text = lambda k: " ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % 20] + str((k * 31 + j) % 97) for j in range(60))
    line = "this line stands in many documents of the corpus"
    rows = [(k, text(k) + (f"\n{line}" if k % 4 == 0 else "")) for k in range(24)]
    rows += [(100, text(3)), (101, text(5) + " more"), (7, text(50)), (102, text(51) + " mail bob@site.org now"), (102, text(51) + " mail bob@site.org now"), (103, None), (104, ""), (105, text(52) + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"')]
    return rows


def test_run_from_end_to_end(spark, tmp_path):
    """All stages over a small table, against what the rules say by hand."""
    rows = small_corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    line = "this line stands in many documents of the corpus"
    left = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert [r["doc_id"] for r in left if line in (r["text"] or "")] == [20]
    one = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in one) == sorted([*range(24), 7, 102, 103, 104, 105])
    assert {r["text"] for r in one if r["doc_id"] == 7} == {t for k, t in rows if k == 7}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in pieces}) == sorted({*range(24), 102, 103, 104, 105})
    for k in {r["doc_id"] for r in pieces}:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == k)
        assert sum(n for _, n, _ in own) == sum({(t) for _, _, t in own}) or k == 7
    masked = corpus_pipeline.mask_personal_data(spark, docs, "").where("doc_id in (102, 105)").collect()
    assert all("<EMAIL>" in r["text"] or "<SECRET>" in r["text"] for r in masked) and not any("9f86d08" in r["text"] or "bob@" in r["text"] for r in masked)


def test_a_corpus_without_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()
