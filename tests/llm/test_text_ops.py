import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cloakframe.llm import packing, sentencepieces, weakpii

KINDS = ("email", "ip", "card", "phone")
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum((2 * int(c) // 10 + 2 * int(c) % 10) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_and_masks(spark, odd, none):
    rng = random.Random(2)
    alphabet = ["a", ".", "@", "b.co", "1", "23", "4532015112830366", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "255", "10.0.0.1"]
    texts = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(150)] + ["x@y.zz " * 300, "bob [at] mail dot com, call (415) 555-2671 now"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in weakpii.span_digest(docs).collect()}
    for k, t in enumerate(texts):
        own = base_spans(t)
        found = [x for x in got[k]["spans"].split(",") if x]
        assert {f"{KINDS[n]}:{a}:{b}" for a, n, b in own} <= set(found)
        assert [got[k][f"n_{n}"] for n in KINDS] == [sum(x[1] == i for x in own) for i in range(4)]
        assert len(found) == len(own) + got[k]["n_added"]
        listed = ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in own)
        assert got[k]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        order = [(int(x.split(":")[1]), weakpii.KINDS.index(x.split(":")[0])) for x in found]
        assert order == sorted(order)
    masked = {r["doc_id"]: r["text"] for r in weakpii.masked(docs).collect()}
    assert masked[150] == "<EMAIL> " * 300
    assert weakpii.span_digest(odd).count() == odd.count() and not weakpii.span_digest(none).count()
    assert {r["text"] for r in weakpii.masked(odd).collect()} == {r["text"] for r in odd.collect()}


def test_added_spans_are_found_and_others_left(spark):
    """Keys, spelled-out addresses, long addresses and bare numbers are added in context; words and versions are not."""
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    good = [f'the token = "{secret}" here', "write to bob [at] mail [dot] com please", "call (415) 555-2671 now", "host 2001:db8:85a3:1:2:8a2e:370:7334 is up", f"api_key: {secret}"]
    bad = ["key: internationalization_of_words", "version 1.2.3.4.5 build 20240101", "order 123 456 7890123", "the key = value pair", "at [at"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good * 30 + bad * 30 + ["mail a.b@site.org from 10.0.0.1"] * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in weakpii.span_digest(docs).collect()}
    want = {0: "secret", 1: "email", 2: "phone", 3: "ip", 4: "secret"}
    for k, t in enumerate(good * 30):
        assert got[k]["n_added"] == 1 and got[k]["spans"].split(":")[0] == want[k % 5], (t, got[k])
    assert not any(got[k]["n_added"] for k in range(150, 300))
    a, b = map(int, got[0]["spans"].split(":")[1:])
    assert good[0][a:b] == secret


def test_em_learns_reliabilities(spark):
    docs = spark.createDataFrame([(k, "mail bob@site.com or card 4532015112830366 and +33 612345678") for k in range(40)], "doc_id long, text string")
    model = weakpii.fit(docs)
    assert len(model.reliabilities) == 6 and len(model.shares) == 5 and all(0.5 < r < 1 for r in model.reliabilities) and all(0 < s < 1 for s in model.shares)


def rebuilt(rows, encoder):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in docs.values():
        at = 0
        for start, n, total in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == parts[0][2]
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    return docs, sequences


def test_packing_is_whole(spark, odd, none):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["the", "Quick", "foo-bar's", "été", "12", "漢字"]) for _ in range(rng.randrange(1, 900))), 1) for k in range(120)], "doc_id long, text string, offset int").coalesce(1)
    rows = packing.pack_documents(docs).collect()
    encoder = packing.Encoder(packing.default_vocabulary())
    by_doc, sequences = rebuilt(rows, encoder)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, parts in by_doc.items():
        assert parts[0][2] == len(encoder.whole.encode(texts[k], add_special_tokens=False).ids) + 1
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used / (len(sequences) * packing.LENGTH) > 0.9
    own = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in own} == {r["doc_id"] for r in odd.collect()} and sum(r["doc_tokens"] == 1 for r in own) == 2
    assert not packing.pack_documents(none).count()


def test_outputs_under_clashing_names(spark):
    """Input columns that bear the names of outputs are left alone; equal rows and lengths are packed and encoded each."""
    clash = spark.createDataFrame([(1, "a b c", 7, 8, 9.5)] * 3 + [(2, "d e f", 7, 8, 9.5)], "doc_id long, text string, length int, sequence_id int, score double")
    rows = packing.pack_documents(clash.coalesce(1)).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4 and {r["length"] for r in rows} == {4}
    encoded = sentencepieces.encode_documents(clash).collect()
    assert len(encoded) == 4 and len({r["ids_crc32"] for r in encoded}) == 2 and all(r["score"] < 0 for r in encoded)


def test_encoder_equals_the_library():
    rng = random.Random(4)
    encoder = packing.Encoder(packing.default_vocabulary(), cache_words=50)
    alphabet = "abcXYZ 012'._-<|>é È€İıſß\n\t'sll re'd ²漢́Σ"
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(800)] + ["<|endoftext|>", "it's I'LL ''s a's's", "x" * 3000, "", " "]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


def test_encoder_keeps_few_words():
    """Words and their parts share one cache, which holds no more than it has room for."""
    encoder = packing.Encoder(packing.default_vocabulary(), cache_words=50)
    encoder.encode([f"word{k} it's-{k} {'abcdefghij'[k % 10] * (1 + k % 7)}" for k in range(500)])
    assert sum(len(x) for x in vars(encoder).values() if isinstance(x, dict)) <= 50


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 700, 500).tolist()
    pieces = packing.pack(lengths)
    cost, used = defaultdict(float), defaultdict(int)
    for _, _, n, seq, _ in pieces:
        cost[seq] += packing.cost(n)
        used[seq] += n
    assert len(used) == -(-sum(lengths) // packing.LENGTH) and max(used.values()) <= packing.LENGTH
    full = [cost[s] for s in used if used[s] == packing.LENGTH]
    assert np.std(full) / np.mean(full) < 0.05


def naive_pack(lengths, length):
    """The rule itself: the longest piece next, to the lowest-cost sequence with room for it, else cut; of equal ones to the fullest."""
    rest = [[n, d, 0] for d, n in enumerate(lengths)]
    free, cost, out = [length] * -(-sum(lengths) // length), [0.0] * -(-sum(lengths) // length), []
    while rest:
        rest.sort(key=lambda x: (-min(x[0], length), x[1], x[2]))
        n, d, at = rest.pop(0)
        take = min(n, length)
        fits = [b for b in range(len(free)) if free[b] >= take]
        if not fits:
            fits = [b for b in range(len(free)) if free[b] > 0]
        best = min(fits, key=lambda b: (cost[b], free[b], b))
        take = min(take, free[best])
        out.append((d, at, take, cost[best]))
        free[best] -= take
        cost[best] += packing.cost(take)
        if n > take:
            rest.append([n - take, d, at + take])
    return sorted(out)


def test_packing_equals_the_rule():
    """Every piece goes where the rule sends it: same pieces, each to a sequence of the same cost; ties in length included."""
    rng = random.Random(7)
    for k in range(40):
        length = rng.choice([16, 64, 300])
        lengths = [rng.choice([1, 5, length // 2, length, rng.randrange(1, 3 * length)]) for _ in range(rng.randrange(0, 60))]
        spent, got = defaultdict(float), []
        for d, at, n, seq, offset in packing.pack(lengths, length):
            got.append((d, at, n, spent[seq]))
            spent[seq] += packing.cost(n)
        assert sorted(got) == naive_pack(lengths, length)


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(sentencepieces.default_model())


def test_search_equals_a_unigram_model(pieces):
    """The same pieces and scores as a unigram model of the library give sums as large."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    unigram = SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["The quick brown fox jumps", "été à la plage naturellement", "internationalization of words", "a b c"]:
        plain = pieces.normalized(text)
        cuts, total = pieces.search(plain)
        theirs = unigram.encode(text, out_type=str)
        assert "".join(cuts) == plain and total >= sum(pieces.score(p) for p in theirs) - 1e-6


def test_chunks_equal_the_sequential_search(pieces):
    rng = random.Random(6)
    words = ["the", "internationalization", "  ", "x", "漢字", "été", "----------------", "\n", "a" * 70, "e.g.)", "foo, (bar)", "it's", "a_b.c,", "C.", "́e"]
    for k in range(30):
        plain = pieces.normalized(("", " ")[k % 2].join(rng.choice(words) for _ in range(25)))
        cuts, total = pieces.search(plain)
        ids = np.array(pieces.ids_of(cuts), np.uint32).tobytes()
        assert pieces.encode(plain)[0] == ids and pieces.decode(ids) == plain
        for size in (5, 33, 90):
            chunks = [(plain[max(0, a - pieces.longest + 1) : a], plain[a : a + size]) for a in range(0, len(plain), size)]
            matrices = [pieces.matrix(*c) for c in chunks]
            state, enters = np.array([0.0] + [sentencepieces.LOW] * (pieces.longest - 1)), []
            for m in matrices:
                enters.append(state)
                state = sentencepieces.applied(m, state)
            assert state[0] == total
            if len(matrices) > 2:
                c = sentencepieces.combined
                assert np.allclose(c(c(matrices[0], matrices[1]), matrices[2]), c(matrices[0], c(matrices[1], matrices[2])))
            leave, out = 0, b""
            for chunk, enter in list(zip(chunks, enters, strict=True))[::-1]:
                out = pieces.backtrace(*chunk, enter, leave)[0] + out
                leave = int(pieces.leaving(*chunk, enter)[0][leave])
            assert out == ids


def best_cut(pieces, text):
    """All ways to cut a text, by recursion: the largest sum, and among equal ones the longest last piece, then the one before it."""
    if not text:
        return 0.0, []
    found = []
    for k in range(1, len(text) + 1):
        own = pieces.scores.get(text[-k:], pieces.unknown if k == 1 else None)
        if own is not None:
            total, cuts = best_cut(pieces, text[:-k])
            found.append((total + own, k, [*cuts, text[-k:]]))
    best = max(found, key=lambda x: (x[0], x[1]))
    return best[0], best[2]


def test_search_equals_all_cuts(pieces):
    rng = random.Random(8)
    for _ in range(60):
        plain = pieces.normalized("".join(rng.choice(["th", "e", "in", "g", " ", "tion", "é", "漢", "s", "1"]) for _ in range(rng.randrange(1, 6))))
        total, cuts = best_cut(pieces, plain)
        assert pieces.encode(plain) == (np.array(pieces.ids_of(cuts), np.uint32).tobytes(), total)


def test_joined_checksums():
    rng = random.Random(9)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 7, 5000]))
        assert sentencepieces.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_documents(spark, odd, none):
    columns = ["doc_id", "n_pieces", "ids_crc32", "score", "round_trip"]
    shown = lambda df: sorted(map(repr, df.select(*columns).collect()))
    two = shown(sentencepieces.encode_documents(odd, giant=10**9))
    # Chunks of 150 characters make trees of five levels in blocks of 5, those of 2,000 of two in blocks of 64.
    for giant, chunk, block in ((20, 150, 5), (20, 2000, 64)):
        assert shown(sentencepieces.encode_documents(odd, giant=giant, chunk=chunk, block=block)) == two
    assert all(r["round_trip"] for r in sentencepieces.encode_documents(odd).collect())
    assert not sentencepieces.encode_documents(none).count()
