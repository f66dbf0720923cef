import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.llm import linededup, minhash

LINES = ["this line is long enough to count", "  THIS line is long enough to COUNT\t", "short", "another line that is long enough"]


def brute_lines(rows):
    texts = {}
    for k, t in rows:
        if k is not None:
            texts.setdefault(k, set()).update(linededup.key_of(x) for x in (t or "").split("\n"))
    holders = {}
    for k, keys in texts.items():
        for key in keys:
            if len(key) >= 20:
                holders.setdefault(key, []).append(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or len(holders.get(linededup.key_of(x), ())) < 3 or max(holders[linededup.key_of(x)]) == k]
        out.append((k, "\n".join(kept), len(lines)))
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r["row"]["doc_id"], r["kept"], r["n_lines"]) for r in df.collect()), key=repr)


def lined(spark):
    rows = [(1, LINES[0] + "\nshort\nshort"), (2, LINES[1] + "\n" + LINES[3]), (3, "\n".join(LINES)), (4, LINES[0]), (5, None), (6, ""), (3, LINES[3]), (None, LINES[0]), (7, LINES[3] + "\n" + LINES[3])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")


def test_line_dedup(spark, none):
    rows, df = lined(spark)
    assert got_lines(linededup.dedup_lines(df)) == brute_lines(rows)
    assert not linededup.dedup_lines(none).count()


def test_line_dedup_in_many_shards_and_tasks(spark, monkeypatch):
    """A very common line is spread over tasks by document, keys over shards; the rows stay those of the rule."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    monkeypatch.setattr(linededup, "TASK_POSTINGS", 20)
    rng = np.random.default_rng(3)
    lines = [f"a line of the corpus with number {k}" for k in range(60)]
    rows = [(int(k), "\n".join(["the line that is in every document", *rng.choice(lines, 3).tolist(), "short"])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = linededup.LineIndex.of(df)
    assert index.shards > 10
    assert got_lines(linededup.drop_lines(df, index)) == brute_lines(rows)


def test_exact_lookup_tells_equal_halves_apart():
    exact = np.array([[1, 1, 1, 5], [2, 3, 9, 0], [10, 20, 30, 40]])
    assert linededup.last_docs(exact, np.array([1, 1, 1, 5, 7]), np.array([9, 2, 4, 0, 0])).tolist() == [30, 10, np.iinfo(np.int64).min, 40, np.iinfo(np.int64).min]


def test_line_index_is_reversible(spark):
    rows, df = lined(spark)
    start = linededup.LineIndex.of(df.where("doc_id <= 4"))
    more = start.add(df.where("doc_id > 4"))
    back = more.delete(df.where("doc_id > 4"))
    keep = [r for r in rows if r[0] is not None and r[0] <= 4]
    assert got_lines(linededup.drop_lines(df.where("doc_id <= 4"), back)) == brute_lines(keep)
    named = [r for r in rows if r[0] is not None]
    assert got_lines(linededup.drop_lines(df.where("doc_id is not null"), more)) == brute_lines(named)
    less = more.delete(df.where("doc_id in (1, 2)"))
    assert got_lines(linededup.drop_lines(df.where("doc_id > 2"), less)) == brute_lines([r for r in named if r[0] > 2])


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    own = linededup.CuckooFilter.of(keys)
    assert own.contains(keys).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 20_000)
    assert own.contains(others).mean() < 0.01
    own.remove(keys[:10_000])
    assert own.contains(keys[10_000:]).all() and own.contains(keys[:10_000]).mean() < 0.01
    again = linededup.CuckooFilter.load(own.dump())
    assert again.contains(keys[10_000:]).all()


def brute_components(rows, words, percent=80):
    sets = [set(minhash.shingles(t, words).tolist()) for _, t in rows]
    comp = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows[:i]):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_minhash_against_all_pairs(spark, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(8):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 14)):
                words[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(200, ""), (201, None), (202, "One"), (203, "one"), (204, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, 2).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert minhash.near_duplicates(odd, 5).count() == odd.count() and not minhash.near_duplicates(none, 5).count()


def test_rows_of_one_document(spark):
    """Different texts under one doc_id, and one text under several, are one component."""
    long = "some words that make a text of its own number"
    rows = [(3, "a b c d"), (5, "a b c d"), (5, long), (5, long), (9, long + " nine"), (7, "x y"), (7, "z w"), (8, "z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 2).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 3, False)]


def test_buckets_and_pivots_cut_over_tasks(spark, monkeypatch):
    """Large groups of near copies in stretches of few rows, with blocks of few members, against all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for noise in (6, 20, 30):
        base = rng.choice(vocabulary, 60).tolist()
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, 60, rng.integers(0, noise)):
                words[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 1, 70).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_components(rows, 1, 70)


def test_runs_and_chunks_in_batches():
    rng = np.random.default_rng(7)
    k = np.sort(rng.integers(0, 30, 400))
    v = np.arange(400)
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (k, v, v + 1)], names=["bucket", "v", "n"])
    for size in (1, 3, 50, 400):
        parts = [whole.slice(at, size) for at in range(0, 400, size)]
        out = pa.Table.from_batches(list(minhash._runs(iter(parts)))).to_pylist()
        least = {x: int(v[k == x].min()) for x in set(k.tolist())}
        assert {(r["bucket"], r["v"]) for r in out if not r["edge"]} == {(a, b) for a, b in zip(k.tolist(), v.tolist(), strict=True) if (k == a).sum() > 1}
        assert all(r["b"] == least[r["bucket"]] and r["m"] == r["b"] + 1 for r in out)
        assert {r["bucket"] for r in out if r["edge"]} == {int(k[0]), int(k[-1])}
        pairs = pa.RecordBatch.from_arrays([pa.array(x) for x in (v, np.sort(rng.integers(0, 2, 400)))], names=["a", "b"])
        cut = pa.Table.from_batches(list(minhash._chunked(pairs.slice(at, size) for at in range(0, 400, size)))).to_pylist()
        assert sorted(r["v"] for r in cut if r["kind"]) == v.tolist()
        by_part = {}
        for r in cut:
            by_part.setdefault((r["b"], r["part"]), []).append(r["kind"])
        assert all(x.count(0) == 1 and x.count(1) <= minhash.CHUNK_ROWS for x in by_part.values())


def test_blocks_find_all_links(spark):
    rng = np.random.default_rng(9)
    base = np.sort(rng.choice(10_000, 100, replace=False)).astype(np.uint64)
    block = minhash.Block(80)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.06], rng.integers(20_000, 30_000, 4).astype(np.uint64)])) for _ in range(20)]
    for k, s in enumerate(sets[:10]):
        block.hold(k, k, s)
    linked = {frozenset(x) for k, s in enumerate(sets[10:], 10) for x in block.links_of(k, k, s)}
    assert all(minhash.similar(sets[a], sets[b], 80) for a, b in map(tuple, linked)) and linked


def test_components_of_a_chain(spark):
    chain = spark.range(40).select((F.col("id") * 7 % 41).alias("a"), ((F.col("id") + 1) * 7 % 41).alias("b"))
    assert {r["root"] for r in minhash.components(chain).collect()} == {0}


def test_circulant_signatures_estimate_similarity():
    a, b = minhash.mixed(np.arange(1000, dtype=np.uint64)), minhash.mixed(np.arange(200, 1200, dtype=np.uint64))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 800 / 1200) < 0.12
    assert hashlib.sha256(minhash.signature(a).tobytes()).hexdigest() == hashlib.sha256(minhash.signature(a).tobytes()).hexdigest()


def test_near_dedup_makes_few_files(spark, monkeypatch):
    """However many partitions shuffles have, a table of few rows is written by as many tasks as cores."""
    made = []
    whole = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, tasks=None: (out := whole(df, tasks), made.append(len(out.inputFiles())))[0])
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = [" ".join(str((i * 7 + k) % 31) if k % (9 + i % 5) else f"w{i % 6}" for k in range(40)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 1, 70).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made) > 5 and max(made) <= spark.sparkContext.defaultParallelism
    assert got == {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 1, 70).collect()} and len(set(got.values())) < 60


def test_parts_of_a_pivot_in_two_partitions_differ():
    """A pivot whose partners go on in another partition, which the same task may read, has parts of its own there."""
    cut = lambda a: pa.Table.from_batches(list(minhash._chunked(iter([pa.RecordBatch.from_pydict({"a": a, "b": [1] * len(a)})]))))
    assert not {r["part"] for r in cut(list(range(2, 300))).to_pylist()} & {r["part"] for r in cut(list(range(300, 600))).to_pylist()}
