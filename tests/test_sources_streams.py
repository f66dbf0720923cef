import hashlib
import json
import random
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from cloakframe.plans import extended
from cloakframe.sources import files
from cloakframe.streaming import ledger, streams


def test_scan_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello 10.0.0.1")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "big.txt").write_text("x" * 100)
    got = files.scan_files(spark, str(tmp_path), most=50).collect()
    assert [r["text"] for r in got] == ["hello 10.0.0.1"]


def test_chat_texts(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "there"}]}], "prompt": "p"})
    assert spark.createDataFrame([(body,)], "body string").select(files.chat_texts().alias("t")).first()["t"] == ["hi", "there", "p"]
    assert spark.sql("select '{}' as body").select(files.chat_texts().alias("t")).first()["t"] == []


def test_reports(spark):
    rows = spark.createDataFrame([("f.txt", "a\nbc 10.0.0.1", 5, 13, "IP_ADDRESS")], "path string, text string, start int, end int, entity_type string")
    place = json.loads(files.sarif(rows).first()["result"])["locations"][0]["physicalLocation"]["region"]
    assert place == {"startLine": 2, "startColumn": 4}
    assert json.loads(files.code_quality(rows).first()["issue"])["fingerprint"] == "f.txt:5:13"


def judged(requests, seconds, most, pause):
    """Outcomes of (time, number) one by one."""
    out, times, until, trial = [], [], 0, False
    for at, number in sorted(requests):
        if at < until:
            outcome, trial = "open", True
        else:
            times = [t for t in times if t > at - seconds]
            if len(times) >= most:
                outcome, until, trial = "tripped", at + pause, True
            else:
                outcome, trial = ("half_open" if trial else "allowed"), False
                times.append(at)
        out.append((at, number, outcome))
    return out


def test_guard_stream_over_batches(spark, tmp_path):
    """Requests in no order over micro-batches are judged in order of time; ones behind the watermark are dropped; state goes."""
    rng = random.Random(4)
    rows = [(rng.choice("pq"), rng.randrange(20_000), k) for k in range(300)]
    stream_rows = sorted(rows, key=lambda r: r[1] + rng.randrange(500))
    late = [("p", 10, 900)]
    for part in (stream_rows[:100], stream_rows[100:200], stream_rows[200:], [("end", 100_000, 901)], [*late, ("end", 200_000, 902)], [("end", 300_000, 903)]):
        spark.createDataFrame(part, "pair string, at long, n long").select("pair", F.timestamp_seconds("at").alias("ts"), "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "pair string, ts timestamp, n long", 1)
    q = streams.guard(stream, "pair", "ts", "n", 600, 3, 400).writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("guarded").collect()
    for pair in "pq":
        want = judged([(at, n) for p, at, n in rows if p == pair], 600, 3, 400)
        assert sorted((r["at"], r["number"], r["outcome"]) for r in got if r["key"] == pair) == sorted(want)
    assert {o for *_, o in want} == {"allowed", "tripped", "open", "half_open"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    batch = streams.guarded_batch(spark.createDataFrame(rows, "pair string, at long, n long"), "pair", "at", "n", 600, 3, 400).where("key = 'q'").collect()
    assert sorted((r["at"], r["number"], r["outcome"]) for r in batch) == sorted(want)


def test_streamed_guard_of_ids_in_another_order_than_times(spark, tmp_path):
    """Events that come again at earlier times under larger ids are judged like all others, over files of bounded size."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.unionByName(events.withColumn("event_id", F.col("event_id") + 100_000)).unionByName(events.withColumn("event_id", F.col("event_id") + 200_000))
    copies.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = extended.streamed_guard(spark, str(tmp_path)).collect()
    rows = copies.select((F.col("user_id") % 4).alias("guard"), F.unix_timestamp("ts").alias("at"), "event_id")
    want = streams.guarded_batch(rows, "guard", "at", "event_id", 3600, 4, 1800).collect()
    assert len(got) == copies.count() and sorted(map(tuple, got)) == sorted(map(tuple, want))
    path = extended._in_order(copies.select("event_id", "ts"), "ts", "event_id", most=500)
    files = sorted(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    parts = [spark.read.parquet(str(f)).agg(F.count("*"), F.min("ts"), F.max("ts")).first() for f in files]
    assert len(files) == 6 and sum(n for n, _, _ in parts) == 3000 and max(n for n, _, _ in parts) <= 700
    assert all(a[2] <= b[1] for a, b in zip(parts, parts[1:]))


def test_restored_chunks(spark, tmp_path):
    """Wherever answers are cut, in whatever order chunks come, the restored whole is that of the whole answer."""
    rng = random.Random(8)
    pairs = {"<P_1>": "Ann", "<P_12>": "Bo<", "<<P_1>": "C", "P_": "d"}
    names = sorted(pairs, key=len, reverse=True)
    rows, want = [], {}
    for k in range(30):
        text = "".join(rng.choice([*pairs, "<", "P", "_1", "x", ">", "é"]) for _ in range(rng.randint(0, 30)))
        out, at = "", 0
        while at < len(text):
            hit = next((n for n in names if text.startswith(n, at)), None)
            out += pairs[hit] if hit else text[at]
            at += len(hit) if hit else 1
        want[str(k)] = out
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 9)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [(str(k), n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rng.shuffle(rows)
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(half, "answer string, number long, chunk string, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "answer string, number long, chunk string, last boolean", 1)
    got = streams.run_once(streams.restored(stream, pairs), "restored", str(tmp_path / "ck")).collect()
    told = {}
    for r in sorted(got, key=lambda r: r["number"]):
        told[r["answer"]] = told.get(r["answer"], "") + r["text"]
    assert told == want


def test_restored_chunks_dealt_to_few_keys(spark, tmp_path):
    """Many answers share a key of the state, and none of them takes or keeps another's chunks."""
    texts = {f"a{k}": f"{k} <P_1" + "2>" * (k % 2) + f" <P_1>{'x' * (k % 5)}" for k in range(40)}
    pairs = {"<P_1>": "Ann", "<P_12>": "Bo"}
    rows = [(a, n, t[n * 3 : n * 3 + 3], n == (len(t) - 1) // 3) for a, t in texts.items() for n in range((len(t) + 2) // 3)]
    schema = "answer string, number long, chunk string, last boolean"
    for half in (rows[1::2], rows[0::2]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.restored(streams.read_rows(spark, str(tmp_path / "in"), schema, 1), pairs, groups=3)
    q = out.writeStream.format("memory").queryName("dealt").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < keys[0] <= 3 and keys[-1] == 0
    told = {}
    for r in sorted(spark.table("dealt").collect(), key=lambda r: r["number"]):
        told[r["answer"]] = told.get(r["answer"], "") + r["text"]
    assert told == {a: t.replace("<P_12>", "Bo").replace("<P_1>", "Ann") for a, t in texts.items()}


def test_ledger_over_restarts(spark, tmp_path):
    """A batch that is run again, cut off before its commit or after it, gives the chains of one run."""
    rng = random.Random(6)
    entries = [(k, rng.choice(["a", "b", None]), f"é{k}") for k in range(60)]
    schema = "k int, log string, actor string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    book = ledger.Ledger(spark, str(tmp_path / "book"), "log", "k", ["actor", "k"], 200)
    book.append(frame(entries[:20]), 0)
    book.append(frame(entries[20:25]), 1)
    shutil.rmtree(tmp_path / "book/heads/batch=1")  # the driver was lost before the commit
    assert book.entries().count() == 20
    book.append(frame(entries[20:40]), 1)
    book.append(frame(entries[20:40]), 1)
    book.append(frame([]), 2)
    book.append(frame(entries[40:]), 3)
    got = {r["k"]: r for r in book.entries().collect()}
    assert len(got) == 60 and book.entries().count() == 60
    for name in ("a", "b", None):
        head, size = "", 0
        for n, (k, _, actor) in enumerate(e for e in entries if e[1] == name):
            text = json.dumps({"actor": actor, "k": k}, separators=(",", ":"), ensure_ascii=False)
            new = hashlib.sha256(f"{head}|{text}".encode()).hexdigest()
            assert (got[k]["number"], got[k]["file"], got[k]["prev_hash"], got[k]["entry_hash"]) == (n, size // 200, head, new)
            head, size = new, size + len(text.encode())
    heads = {r["log"]: (r["entries"], r["bytes"]) for r in book.heads().collect()}
    assert sum(n for n, _ in heads.values()) == 60 and len(heads) == 3


def test_rates_stream_counts_windows(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("a").alias("k")).write.parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "ts timestamp, k string")
    got = streams.run_once(streams.rates(stream, "ts", "k"), "rated", str(tmp_path / "ck"), "complete").orderBy("window_start").collect()
    assert [r["n"] for r in got] == [5, 5]
