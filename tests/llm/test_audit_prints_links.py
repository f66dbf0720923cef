import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from cloakframe.llm import alignment, filteraudit, winnowing

INK = r"[^\x20\x09-\x0D]"
M = (1 << 64) - 1


def failures(text, copy):
    w = re.findall(INK + "+", text)
    fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), copy]
    return {f for f, x in zip("ABCDE", fails, strict=True) if x}


def audited(docs, labels):
    """Each order applied filter by filter."""
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    flag = lambda k, i: k is not None and any(x[0] == k and x[i] == 1 for x in labels)
    rows = [(lang or "", failures(t or "", k is not None and k > first[t or ""]), flag(k, 1), flag(k, 2)) for k, t, lang in docs]
    out = set()
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        taken = Counter()
        steps = []
        for order in permutations("ABCDE"):
            seen = set()
            for k, f in enumerate(order):
                gone = [r for r in own if f in r[0] and not r[0] & seen]
                taken[f] += len(gone)
                kept = sum(not r[0] & (seen | {f}) for r in own)
                again = sum(f in r[0] and bool(r[0] & seen) for r in own)
                steps.append((part, "".join(order), k + 1, kept, len(gone), again, sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
                seen.add(f)
        out |= {(*s[:-1], taken[s[-1]]) for s in steps}
    return out


def test_audit_equals_all_orders(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(220))
    texts = [None, "", "short", long, long + " A#", "the the " * 150, "ABC " * 10, "ok | no", long.upper(), "a" * 5000]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(20) for _ in range(2)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, lang string, mask int, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(frame, marks).collect()
    assert {tuple(r) for r in got} == audited(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_audit_of_odd_and_no_documents(spark, odd, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(odd, marks).collect()
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert {tuple(r) for r in got} == audited(docs, [])
    assert not filteraudit.audit(none, marks).count()


def rolled(units):
    rot = lambda x, by: ((x << by) | (x >> (64 - by))) & M
    k = winnowing.K
    out = []
    for i in range(len(units) - k + 1):
        h = 0
        for j in range(k):
            h ^= rot(units[i + j] & M, k - 1 - j) if j < k - 1 else units[i + j] & M
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def winnowed(hashes):
    """Rightmost least hash, by its leading 40 bits, of each window."""
    size = min(winnowing.WINDOW, len(hashes))
    out = []
    for s in range(len(hashes) - size + 1):
        window = [h >> winnowing.PLACE for h in hashes[s : s + size]]
        at = s + size - 1 - window[::-1].index(min(window))
        if not out or out[-1] != at:
            out.append(at)
    return out


ODD_TEXTS = ["a " * 300, "ab" * 200, "x" * 15, "x y z a", "x y z a b", "a b c d e f g h i j k l m n o p q r s t", "é🙂" * 100, "long words " * 3000, "", None, "q", " \n ", "日本語" * 50 + " a b"]


@pytest.mark.parametrize("block", [None, 40])
def test_prints_equal_a_walk_over_windows(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(winnowing, "_BLOCK", block)
    rng = random.Random(7)
    texts = ODD_TEXTS + [" ".join(rng.choice(["a", "b", "c", "dd", "x" * 33]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    units = f"transform(regexp_extract_all(coalesce(text, ''), {winnowing.lit(winnowing._UNIT)}, 0), u -> xxhash64(u))"
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", f"{units} AS u", f"{winnowing.prints_sql('text')} AS p").collect()
    for r in rows:
        words = [w for run in re.findall(INK + "+", r["text"] or "") for w in ([run] if len(run) <= winnowing.LONGEST else run)]
        assert len(words) == len(r["u"])
        if len(words) < winnowing.K:
            assert [p["pos"] for p in r["p"]] == [0] * bool(words)
            continue
        hashes = rolled(r["u"])
        assert [(p["hash"], p["pos"]) for p in r["p"]] == [(hashes[k], k) for k in winnowed(hashes)]


def test_shared_passages_share_prints(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(winnowing.K + winnowing.WINDOW - 1))
    texts = [(k, " ".join([word() for _ in range(k % 17)] + [passage] + [word() for _ in range(k)])) for k in range(40)]
    found = [{p["hash"] for p in r["p"]} for r in spark.createDataFrame(texts, "k int, text string").select(winnowing.prints("text").alias("p")).collect()]
    assert set.intersection(*found)


def test_fingerprints_of_documents(spark, odd, none):
    rng = random.Random(3)
    docs = [(k, rng.choice(["", "one two three four five six", "é🙂 b " * rng.randint(0, 30), " ".join(rng.choice("abcdefg") for _ in range(80))])) for k in rng.sample(range(10**12), 60)]
    got = {r["doc_id"]: r for r in winnowing.fingerprints(spark.createDataFrame([(k, t, 0, "") for k, t in docs], "doc_id long, text string, own int, next string")).collect()}
    ordered = sorted(docs, reverse=True)
    prints = {}
    for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
        of = lambda x: {p.split(":")[0] for p in x.split(",") if p}
        like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        assert got[k]["near_edited"] == like(of(got[k]["fingerprint"]), of(got[k]["edited_fingerprint"]))
    for (k, _), (n, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert got[k]["near_next"] == like(of(got[k]["fingerprint"]), of(got[n]["fingerprint"]))
    out = winnowing.fingerprints(odd).collect()
    assert len(out) == odd.count() and not winnowing.fingerprints(none).count()
    only = winnowing.fingerprints(odd.where("doc_id = 6")).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()


def test_next_over_repeated_ids(spark):
    """Every row has one next row, whatever ids repeat; a third of all rows have one id."""
    rows = [(5, f"t{k}") for k in range(100)] + [(k, "u") for k in range(10, 200)] + [(None, "n"), (5, "t1")]
    out = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    assert Counter(r["next"]["text"] for r in out) == Counter(t for _, t in rows)


def test_order_does_not_hang_on_where_rows_lie(spark):
    """Rows are read several times, and a shuffle gives them in another order each time."""
    rows = spark.createDataFrame([(k % 7, f"t{k % 30}") for k in range(200)] + [(None, None)], "doc_id long, text string")
    keys = [sorted(r["__key"] for r in winnowing._ordered(x).collect()) for x in (rows.coalesce(1), rows.repartition(5))]
    assert keys[0] == keys[1] and len(set(keys[0])) == 201 - 200 + len({(k % 7, k % 30) for k in range(200)})


def aligned(a, b):
    """Groups and links of two lists of (id, bytes), by brute force over byte ranges."""
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, n in side:
            own.append((i, at, at + n))
            at += n
        spans.append(own)
    common = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
    groups = []
    for lo, hi in zip([0, *common], common):
        groups.append("|".join(",".join(str(i) for i, s, e in own if lo <= s and e <= hi) for own in spans))
    links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
    return groups, links


def test_alignment_equals_brute_force(spark, odd, none):
    rng = random.Random(9)
    alphabet = ["a", "the ", "é", " ", "\n", "▁", "🙂", "12", "don't ", "  ", "<|endoftext|>", "</s>", "\x00", "ﬁ", "日本", "international", " token", "\na", "\n\nB "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "the cat sat on the mat " * 400, "the cat"]
    docs = [(k, t, 0) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string, a int")).collect()}
    pair = alignment.Pair(*alignment.default_vocabularies())
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    every = {}
    for k, t, _ in docs:
        ids = pair.b.encode(t) if t else []
        if not t or b"".join(pair.b_bytes[i] for i in ids) != b" " + t.encode():
            every[k] = ([], [], [], [])
            continue
        a = [(i, int(pair.a_size[i])) for i in plain.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, len(pair.b_bytes[i])) for i in ids]
        every[k] = (a, b, *aligned(a, b))
    counts = Counter(x for e in every.values() for x in e[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    for k, (a, b, groups, links) in every.items():
        want = (len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == want
        assert got[k]["groups_sha256"] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    assert alignment.align(odd).count() == odd.count() and not alignment.align(none).count()


def test_alignment_without_held_pairs(spark, monkeypatch):
    """All pairs met by a join give what held ones give."""
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * k + "x") for k in range(12)] + [(3, "again")], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, alignment.align(docs).collect()))
    held = rows()
    for most in (0, 3):
        monkeypatch.setattr(alignment, "HELD", most)
        assert rows() == held


def test_texts_aligned_together_equal_brute_force(monkeypatch):
    """Texts in one stretch of numpy steps give each what brute force gives alone, those without tokens nothing."""
    rng = random.Random(4)
    found, want = [], []
    for n in (5, 0, 1, 60, 0, 200, 3, 0):
        sides = []
        for _ in range(2):
            cuts = sorted({n, *(rng.randint(1, n) for _ in range(n // 2))}) if n else []
            sides.append([(rng.choice([0, 9, 10, 4096, 50256, (1 << alignment.ID_BITS) - 1]), y - x) for x, y in zip([0, *cuts], cuts)])
        found.append(tuple(b"".join((i | size << alignment.ID_BITS).to_bytes(4, "little") for i, size in side) for side in sides))
        want.append((*map(len, sides), *aligned(*sides)))
    monkeypatch.setattr(alignment, "ALIGNED", 40)
    stretches = list(alignment._cut(found))
    assert len(stretches) > 2 and [k for s in stretches for k in range(len(found))[s]] == list(range(len(found)))
    for some in (slice(0, None), *stretches, slice(1, 2)):
        n_a, n_b, n_groups, n_links, digests, pairs = alignment.aligned(found[some])
        own = want[some]
        assert list(zip(n_a, n_b, n_groups, n_links)) == [(a, b, len(g), len(x)) for a, b, g, x in own]
        assert digests == [hashlib.sha256(";".join(g).encode()).hexdigest() if g else "" for _, _, g, _ in own]
        at = 0
        for n, (*_, links) in zip(n_links, own):
            assert Counter((p >> 32, p & 0xFFFFFFFF) for p in pairs[at : at + n].tolist()) == Counter(links)
            at += n
