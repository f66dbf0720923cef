import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import additive, maxent, toxicity


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_distances():
    terms = ["scum$", "idiot$", "disgusting$", "lowei"]
    auto = toxicity.Automaton.of(terms)
    rng = np.random.default_rng(3)
    words = ["scum", "idiot", "idoit", "idiots", "idit", "disgustng", "dsigusting", "disgutsnig", "loweichen", "lowexi", "clean", "id1ot", "sum"]
    words += ["".join(rng.permutation(list("idiotsm"))[: rng.integers(3, 8)]) for _ in range(300)]
    of, word, at, term, dist, counts = auto.scan([" ".join(words)])
    hits = dict(zip(word.tolist(), zip(term.tolist(), dist.tolist(), strict=True), strict=True))
    for k, w in enumerate(words):
        w = "".join(toxicity.FOLDED.get(c, c) for c in w)
        want = []
        for t, name in enumerate(terms):
            allowed = toxicity.edits_allowed(name)
            if name.endswith("$"):
                d = distance(w, name[:-1])
            else:
                d = min(distance(w[:n], name) for n in range(len(w) + 1))
            if d <= allowed:
                want.append((d, t))
        assert (k in hits) == bool(want), (w, want, hits.get(k))
        if want:
            assert hits[k][1] == min(want)[0], (w, want, hits[k])
    assert counts.tolist() == [len(words)]


def test_quotation_counts_apart():
    text = 'he said "you idiot" twice\nidiot'
    assert toxicity.quoted(text, text.index("idiot")) and not toxicity.quoted(text, text.rindex("idiot"))
    model = toxicity.Model(["idiot$"], {(0, 0): 4.0}, [-3.0, 1.5, 0.0, 0.0, 0.0])
    auto = toxicity.Automaton.of(model.terms)
    plain, cited, none = model.scores(auto, ["you idiot", 'they wrote "idiot" there', ""])
    assert plain > 0.5 > cited == none


def toxic_docs(spark):
    rng = np.random.default_rng(1)
    clean = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(400):
        words = rng.choice(clean, 60).tolist()
        if k % 4 == 0:
            for w in rng.choice(["idiot", "pathetic", "worthless"], 3):
                words[rng.integers(60)] = w
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t, 5) for k, t, _ in rows], "doc_id long, text string, score int")
    return rows, docs, spark.createDataFrame([(k, 0, y) for k, _, y in rows], "doc_id long, quality int, toxic int")


def test_toxicity_holds_out(spark, odd, none):
    rows, docs, labels = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_ids(docs, model).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in held) for k, _, _ in rows)
    assert np.mean([got[k]["predicted"] == y for k, _, y in rows if k in held]) > 0.97
    fuzzy = spark.createDataFrame([(1, "you worthles patheitc thing, worthlss")], "doc_id long, text string")
    assert toxicity.score_ids(fuzzy, model).first()["score"] > toxicity.score_ids(odd.limit(1), model).first()["score"]
    assert toxicity.score_ids(odd, model).count() == odd.count() and toxicity.score(none, model).columns == ["row", "score"]
    assert toxicity.fit(none, labels).terms == [] and toxicity.fit(docs, labels.where("toxic = 0")).terms == []


def test_toxicity_sends_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b", 2.5), (2, None, None), (3, "", 1.0), (4, "foo bar " * 40, 0.0)], "doc_id long, text string, row double")
    model = toxicity.Model(["foo$"], {(0, 0): 2.0}, [-1.0, 1.0, 0.5, 0.0, 0.0])
    out = toxicity.score(docs, model)
    # What goes to the tasks' Python is the row alone, in whose text alone the scores are found.
    assert len(out._jdf.queryExecution().analyzed().children().apply(0).output().mkString("|").split("|")) == 1
    got = {r["row"]["doc_id"]: (tuple(r["row"]), r["score"]) for r in out.collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    assert {k: s for k, (_, s) in got.items()} == {r["doc_id"]: r["score"] for r in toxicity.score_ids(docs.select("doc_id", "text"), model).collect()}
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 5, None, "", "y" * 20, "z", "z"]})
    parts = list(toxicity.slices(batch, batch.column(0), 10))
    assert [p.num_rows for p in parts] == [4, 2] and sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()


def test_toxicity_of_any_script(spark):
    terms = ["идиот", "ΗΛΊΘΙΟΣ", "أحمق", "मूर्ख", "混蛋东西", "ngốc"]
    rows = [(k, f"слово {['один', 'два', 'три'][k % 3]} word{k} " + (f"„{terms[k // 4 % 6]}” 😀" if k % 4 == 0 else "")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    learned = toxicity.fit(docs, labels).terms
    assert len(learned) >= len(terms)
    auto = toxicity.Automaton.of(learned)
    of, word, *_ = auto.scan([f"😀{t.swapcase()}—" for t in terms] + ["слово", "ngoc", ""])
    assert of.tolist() == [0, 1, 2, 3, 4, 5] and set(word.tolist()) == {0}
    held = {r["doc_id"]: r["predicted"] for r in toxicity.score_ids(docs, toxicity.fit(docs, labels)).where("held_out").collect()}
    assert np.mean([y == (k % 4 == 0) for k, y in held.items()]) > 0.97


@pytest.mark.parametrize("between", ["", "，"])
def test_toxicity_of_scripts_without_spaces(spark, between):
    """A fixed insult inside runs of Chinese is learned and found, whatever stands around it."""
    rng = random.Random(3)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(800)]
    rows = []
    for k in range(600):
        parts = ["".join(rng.choice(han) for _ in range(rng.randint(5, 25))) for _ in range(6)]
        if k % 2:
            parts[rng.randrange(6)] += "蠢货滚开吧"
        rows.append((k, between.join(parts), k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.terms and all(set(t) & set("蠢货滚开吧") for t in model.terms)
    held = toxicity.score_ids(docs.select("doc_id", "text"), model).where("held_out").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) >= 0.95


def test_long_runs_are_searched_at_every_place(spark):
    auto = toxicity.Automaton.of(["wortless"])
    long = "x" * 40 + "wortless" + "y" * 40
    of, word, at, *_ = auto.scan([long, "xxxwortless", "wortlessy", "ab " + "蠢" + "wortless"])
    assert set(of.tolist()) == {0, 2, 3} and 40 in at[of == 0].tolist() and 4 in at[of == 3].tolist()


def test_accidents_are_no_terms(spark):
    """Of many thousands of rare words none is a term if toxicity is dealt out by chance."""
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(60)), int(rng.random() < 0.1)) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).terms) <= 1


def test_toxicity_learns_rare_and_many_terms(spark):
    letters = "bcdfghjklmnpqrstvwz"
    marks = ["".join(letters[(k * 7 + j * (k % 5 + 3) + k // 19) % 19] for j in range(7)) + f"{letters[k % 19]}{letters[k // 19]}" for k in range(150)]
    rows = [(k, f"some plain text {k % 7} here " + (marks[k // 4 % 150] if k % 4 == 0 else "again")) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    auto = toxicity.Automaton.of(model.terms)
    of, _, _, _, dist, _ = auto.scan(marks)
    assert of.tolist() == list(range(150)) and not dist.any()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in toxicity.score_ids(docs, model).collect())


def test_tables_together_find_what_one_finds(monkeypatch):
    rng = np.random.default_rng(12)
    terms = sorted({"".join(rng.choice(list("abcde"), rng.integers(4, 12))) + "$" for _ in range(40)})
    words = ["".join(rng.choice(list("abcdex"), rng.integers(2, 16))) for _ in range(2000)] + [t[1:-1] for t in terms]
    many = toxicity.Automaton.of(terms)
    monkeypatch.setattr(toxicity, "TABLE_TERMS", 1)
    single = toxicity.Automaton.of(terms)
    text = [" ".join(words), "", " ".join(words[::-1])]
    assert len(many.tables) == 3 and len(single.tables) == len(terms)
    assert all((a == b).all() for a, b in zip(many.scan(text), single.scan(text), strict=True))


def test_softmax_sums_to_one():
    rng = np.random.default_rng(2)
    shape = maxent.Shape.of(20_000)
    w = maxent.Weights.zeros(shape)
    for name in maxent.NAMES:
        table = getattr(w, name)
        table += rng.normal(0, 1, table.shape).astype(np.float32)
    a, b = np.full(shape.start, 17), np.full(shape.start, 301)
    p = np.exp(maxent.score_ids(w, a, b, np.arange(shape.start)))
    assert abs(p.sum() - 1) < 1e-4


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    shape = maxent.Shape.of(300_000)
    w, g = maxent.Weights.zeros(shape), maxent.Weights.zeros(shape)
    w.last += rng.normal(0, 0.3, w.last.shape).astype(np.float32)
    k = np.array([(5 * shape.ids + 9) * shape.all + 3, (5 * shape.ids + 9) * shape.all + 7])
    c = np.array([4.0, 1.0], np.float32)
    base = maxent.class_gradient(w, g, k, c)
    row = maxent.rows_class(shape, np.array([5]), np.array([9]))[0][0]
    step = maxent.Weights(*(x.copy() for x in (w.last, w.skip, w.both, w.inner, w.bias, w.own)), shape)
    step.last[row, 3] += 1e-2
    assert abs((maxent.class_gradient(step, maxent.Weights.zeros(shape), k, c) - base) / 1e-2 - g.last[row, 3]) < 0.05


def test_scores_and_base(spark, odd, none):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(120):
        words, state = [], 0
        for _ in range(80):
            state = (state * 3 + int(rng.integers(2))) % 30
            words.append(f"T{state}")
        rows.append((k, " ".join(words) + (f" rare{k}" if k % 3 == 0 else "")))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, score int").unionByName(odd.selectExpr("doc_id + 1000 as doc_id", "text", "1 as score"))
    counts, texts = Counter(), [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k, t in texts:
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            counts.update([*maxent.tokens_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    base = sorted(round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*maxent.tokens_of(t), b""]), 6) for _, t in texts)
    got = maxent.score_documents(docs, 3).toPandas()
    assert sorted(got.base_score.round(6)) == pytest.approx(base) and set(got.train_tokens) == {n}
    held = got[got.held_out & (got.doc_id < 1000)]
    assert held.score.sum() > held.base_score.sum()
    assert sorted(got.n_known) == sorted(sum(w in counts for w in [*maxent.tokens_of(t), b""]) for _, t in texts)
    assert not maxent.score_documents(none, 1).count()


def dense_scores(texts, w, shape, reader, counts, total_of_class):
    """log10 of texts' probabilities, token by token, with softmaxes written out."""
    out = []
    for t in texts:
        a = b = shape.start
        score = 0.0
        for token in [*maxent.tokens_of(t), b""]:
            k = reader.known.get(token, -1)
            k = k if 0 <= k < shape.head else shape.head + maxent.tail_class(token, shape.tail)
            x, y, xy = (int(r[0]) for r in maxent.rows_class(shape, np.array([a]), np.array([b])))
            z = (w.last[x] + w.skip[y] + w.both[xy] + w.bias[0]).astype(float)
            c = k // shape.width if k < shape.head else shape.classes + k - shape.head
            p = math.exp(z[c]) / sum(math.exp(v) for v in z)
            if k < shape.head:
                z = (w.inner[int(maxent.rows_inner(shape, np.array([a]), np.array([c]))[0])] + w.own[c]).astype(float)
                p *= math.exp(z[k % shape.width]) / sum(math.exp(v) for v in z)
            else:
                p *= (counts.get(token, 0) + 0.1) / total_of_class[k - shape.head]
            score += math.log10(p)
            a, b = k, a
        out.append(score)
    return out


def test_scores_equal_a_dense_model(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)] + ["2024", "--", "x9"]
    texts = [" ".join(rng.choice(words, 30, p=None)) for _ in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 10:
            counts.update([*maxent.tokens_of(t), b""])
    order = sorted(counts, key=lambda t: (-counts[t], t))
    vocabulary = maxent.Vocabulary(order, [counts[t] for t in order], sum(counts.values()), len(counts), maxent.Shape.of(len(counts)))
    learn = docs.where(maxent.training_rows("doc_id", 10))
    w, losses = maxent.train(maxent.training_events(learn, vocabulary), vocabulary, 6, 0.0)
    assert losses[-1] > losses[0]
    shape = vocabulary.shape
    mass = [0.1] * shape.tail
    for t in order[shape.head :]:
        mass[maxent.tail_class(t, shape.tail)] += counts[t] + 0.1
    got = maxent.score_documents(docs, 6).toPandas().sort_values("doc_id").score
    # The query stops where a step gains little; with as many steps the scores are the same.
    again, _ = maxent.train(maxent.training_events(learn, vocabulary), vocabulary, 6)
    want = dense_scores(texts, again, shape, maxent.Reader(vocabulary), counts, mass)
    assert got.tolist() == pytest.approx(want, abs=1e-3)


def test_shapes_grow_with_the_corpus():
    sizes = [maxent.Shape.of(10**k) for k in range(1, 10)]
    assert all(a.head <= b.head and a.last <= b.last for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[8].head > 30 * sizes[4].head
    assert sum(x.size for x in (maxent.Weights.zeros(sizes[6]).last, maxent.Weights.zeros(sizes[6]).inner)) < 2e7


def brute_nearest(rows, k=5):
    fine = {i: np.array(e, float) for i, e in rows if i is not None and e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    out = []
    for q in sorted(fine):
        if q % 50:
            continue
        near = sorted((-round(float(fine[q] @ fine[c] / np.linalg.norm(fine[q]) / np.linalg.norm(fine[c])), 9), c) for c in fine if c != q)[:k]
        out += [(q, r, c) for r, (_, c) in enumerate(near, 1)]
    return out


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist()) for k in range(300)]
    rows += [(400 + k, rows[7][1]) for k in range(20)] + [(450, rows[7][1]), (500, None), (550, [0.0] * 4), (600, [float("nan"), 0.0, 1.0, 0.0]), (650, [1.0, None, 0.0, 0.0]), (700, [1.0]), (None, rows[1][1]), (7, rows[7][1]), (750, [float("inf"), 0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, rank int")
    got = additive.search(table, table.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == brute_nearest(rows)
    assert not additive.search(table.where("false"), table, 5).count()
    few = table.where("vec_id in (50, 51)")
    assert [(r["query_id"], r["vec_id"]) for r in additive.search(few, few.where("vec_id = 50"), 5).collect()] == [(50, 51)]


def test_search_finds_the_nearest_among_many_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(7000, 32)).astype(np.float32)
    x[:3000] = x[0] + 1e-3 * rng.normal(size=(3000, 32))
    table = spark.createDataFrame([(k, e) for k, e in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = additive.search(table, table.where("vec_id % 500 = 0"), 5).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = {q: [c for c in np.argsort(-(u @ u[q]), kind="stable").tolist() if c != q][:5] for q in range(0, 7000, 500)}
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(q, r, c) for q in near for r, c in enumerate(near[q], 1)]


def test_codebooks_bring_the_driver_their_sample_alone(spark):
    rows = spark.range(0, 900, 1, 9).select(F.col("id").alias("cls"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    got = additive.least_hashed(rows, 20)
    assert got.collect() == rows.orderBy(F.xxhash64("embedding"), "cls").select("embedding").limit(20).collect()
    # A sort with a limit would send so many rows of every partition to the driver.
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert additive.least_hashed(rows.limit(3), 20).count() == 3


def test_blocks_of_queries_and_codes_meet_by_a_shuffle(spark, monkeypatch):
    """A broadcast would bring the driver a copy of all query vectors for each block of codes."""
    wave = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * j + F.col("id") * F.col("id") % 97).cast("float"))
    table = spark.range(1, 601, 1, 3).select(F.col("id").alias("vec_id"), wave.alias("embedding"))
    classes, asked = table.withColumnRenamed("vec_id", "cls"), table.withColumnRenamed("vec_id", "cls").where("cls % 5 = 0")
    met = additive.candidates(classes, asked, additive.fit(classes), 3)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    # Many blocks on both sides, of some 32 rows, find what one would.
    monkeypatch.setattr(additive, "BLOCK", 256, raising=False)
    got = additive.search(table, table.where("vec_id % 5 = 0"), 3).collect()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}
    assert len(got) == 360 and {r["rank"] for r in got} == {1, 2, 3}
    for q in range(5, 601, 5):
        true = sorted((float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)) for c, v in x.items() if c != q), reverse=True)[:3]
        assert np.allclose([r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q], true, atol=1e-12)


def test_beam_is_no_worse_than_greedy_and_recall_holds():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive.Codebooks.fit(x[:2000], books=8, words=64, rounds=4)

    def error(beam):
        codes, norms = books.encode(x[:500], beam)
        total = sum(books.books[m][codes[:, m]] for m in range(8))
        assert np.allclose(norms, np.linalg.norm(total, axis=1), atol=1e-4)
        return ((x[:500] - total) ** 2).sum()

    assert error(8) <= error(1)
    codes, norms = books.encode(x)
    found, _ = additive.top_by_tables(books.tables(x[:50]), codes, norms, 200)
    true = np.argsort(-(x[:50] @ x.T), axis=1)[:, 1:6]
    assert np.mean([len(set(t) & set(f)) / 5 for t, f in zip(true, found, strict=True)]) >= 0.9
    assert isinstance(additive.unit(pd.Series([np.array([3.0, 4.0])])), np.ndarray)


def test_merged_events_hold_little_of_a_batch():
    """A batch of many packs of the same events is summed in a part of the memory that the batch has."""
    import tracemalloc

    rng = np.random.default_rng(3)
    every = np.unique(rng.integers(0, 1 << 40, 50_000))
    packs = []
    for part, kind, n in ((0, 0, 60), (0, 1, 1), (4, 0, 3)):
        for _ in range(n):
            k = np.sort(rng.choice(every, len(every) - 100, replace=False))
            packs.append((part, kind, k, rng.integers(1, 9, len(k))))
    batch = pa.Table.from_batches([maxent._pack(*p) for p in packs]).combine_chunks().to_batches()[0]
    want = {}
    for part, kind, k, c in packs:
        own = want.setdefault((part, kind), np.zeros(len(every), np.int64))
        own[np.searchsorted(every, k)] += c
    tracemalloc.start()
    got = {}
    for b in maxent._merged(iter([batch.slice(0, 30), batch.slice(30)])):
        for part, kind, k, c in zip(*(b.column(n).to_pylist() for n in maxent.EVENTS.names), strict=True):
            k, c = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
            assert (np.diff(k) > 0).all() and (c > 0).all()
            own = got.setdefault((part, kind), np.zeros(len(every), np.int64))
            own[np.searchsorted(every, k)] += c
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == set(want) and all((got[x] == want[x]).all() for x in want)
    assert batch.nbytes > 48e6 and peak < 32e6
