import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm import chat, matroska


@given(st.binary(min_size=0, max_size=40_000))
@settings(max_examples=40, deadline=None)
def test_mux_round_trip(data):
    payload = data.ljust(-(-len(data) // 192) * 192, b" ")
    found = matroska.demux(matroska.mux(payload))
    media = matroska.mux(payload)
    assert found.error is None and b"".join(media[p.offset : p.offset + p.length] for p in found.packets) == payload
    assert len(found.cues) == found.clusters and [p.timestamp_ns for p in found.packets] == [24_000_000 * k for k in range(len(found.packets))]


def test_cues_point_at_clusters():
    media = matroska.mux(bytes(192 * 8 * 64 * 2 + 192))
    found = matroska.demux(media)
    assert found.clusters == 3
    assert all(media[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, at in found.cues)
    assert {p.lacing for p in found.packets} == {"none", "xiph", "fixed", "ebml"}


@pytest.mark.parametrize("kind", [1, 3])
def test_laces_of_unequal_frames(kind):
    sizes = [1, 700, 3, 255, 256, 90]
    lace = matroska._laces(kind, sizes)
    data = lace + bytes(sum(sizes))
    starts = matroska._frames(data, 0, len(data), kind)
    assert [b - a for a, b in zip(starts, starts[1:], strict=False)] == sizes


def test_unknown_sizes_and_block_groups():
    block = b"\x81\x00\x05\x00" + b"abc"
    cluster = matroska.number(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    head = matroska.element(matroska.EBML, b"")
    live = head + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    for _ in range(2):
        live += matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    found = matroska.demux(live)
    assert found.error is None and found.clusters == 2
    assert [(p.timestamp_ns, p.length, p.keyframe) for p in found.packets] == [(12_000_000, 3, True)] * 2


def test_damage_never_raises():
    media = matroska.mux(bytes(range(256)) * 12)
    rng = random.Random(1)
    for _ in range(300):
        bent = bytearray(media[: rng.randrange(len(media))])
        if bent:
            bent[rng.randrange(len(bent))] = rng.randrange(256)
        matroska.demux(bytes(bent))
    assert matroska.demux(None).error == "null" and matroska.demux(b"").error


def test_digest_of_odd_documents(spark, odd, none):
    rows = matroska.document_digest(odd).collect()
    assert len(rows) == odd.count() and not matroska.document_digest(none).count()
    for r in rows:
        text = next(t["text"] for t in odd.where("doc_id <=> %s" % ("null" if r["doc_id"] is None else r["doc_id"])).collect())
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        media = matroska.mux(payload)
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        frames = len(payload) // 192
        parts = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(parts["packets"]) == frames and int(parts["clusters"]) == -(-frames // 512) == int(parts["cues"]) and int(parts["last_ms"]) == 24 * (frames - 1)
        assert sum(int(parts[k]) for k in matroska.LACINGS) == frames and parts["error"] == ""
        assert abs(float(parts["level"]) - sum(payload) / len(payload)) < 1e-5 and [int(parts[k]) for k in ("spaces", "lines", "e")] == [payload.count(b) for b in (b" ", b"\n", b"e")]
        # The payload stands in the file in order, in frames of 192 bytes.
        at = 0
        for k in range(min(frames, 40)):
            at = media.index(payload[192 * k : 192 * k + 192], at) + 192
    packets = matroska.packet_table(matroska.with_media(spark.createDataFrame([(1, b"x" * 500), (2, None)], "id int, payload binary"), "id", "payload"), "id").collect()
    assert [p["length"] for p in packets] == [192, 192, 116]


TEXTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", " [/INST]", "\\", "<<SYS>>", "[NAME]", "a", "<", "]", "\n", "<a>", "[ROLE]"]), max_size=8).map("".join)


@given(TEXTS)
@settings(deadline=None)
def test_escape_round_trip(text):
    own = chat.escaped(text)
    assert chat.unescaped(own) == text and not any(c in own for c in chat.DEFAULT.controls)


@given(st.sampled_from(["user", "assistant", "system", "", "tool", "[NAME]x"]), TEXTS)
@settings(deadline=None)
def test_turn_round_trip(role, text):
    assert chat.read_turn("".join(s for s, _, _ in chat.segments(role, text))) == (role, text)


def test_machine_and_digest(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST]"), (1, 2, "assistant", "ok"), (2, 0, "assistant", None), (2, 0, None, "x"), (3, 5, "user", "b"), (3, 5, "user", "a"), (None, 0, "user", "n")]
    convs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_segments(convs)).collect()}
    assert got[1]["violation"] is None and got[2]["violation"] == 0 and got[3]["violation"] == 1 and got[None]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\n</s>[INST]\nassistant\nok\n").hexdigest()
    assert got[1]["loss_chars"] == 2 and got[3]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest()
    assert not chat.conversation_digest(chat.format_segments(convs.where("false"))).count()
    assert chat.with_probe(convs).where("conv_id = -7").count() == 2
