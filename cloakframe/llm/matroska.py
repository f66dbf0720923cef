"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores bytes as one 8-bit PCM track; ``demux`` reads any Matroska or WebM file of known or unknown element
sizes. Blocks are cut at their lacing (none, Xiph, fixed, EBML) into packets with track, timestamp and byte range.

Defined cases: a null media value gives no packets and the error "null"; bytes that break off or hold an impossible
size give the packets read so far and an error that names the place; empty payloads give a file without clusters.
Rows are independent, so repeated rows give repeated results; other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

# Fixed values of the Matroska format (RFC 9559, RFC 8794): element ids.
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, RATE = 192, 8, 64, 8000
FRAME_MS = FRAME * 1000 // RATE


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    lacing: str
    cluster: int


PACKET = T.StructType(
    [T.StructField("track", T.LongType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("keyframe", T.BooleanType()), T.StructField("lacing", T.StringType()), T.StructField("cluster", T.LongType())]
)


def vint(value: int, width: int = 0) -> bytes:
    """``value`` as an EBML size of the least or the given width."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laces(kind: int, sizes: list[int]) -> bytes:
    """What stands between a block's header and its frames; every frame but the last has its size told."""
    if kind == 0:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 2:
        return head
    out = [vint(sizes[0])]
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        step = now - before
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        out.append(vint(step + (1 << 7 * width - 1) - 1, width))
    return head + b"".join(out)


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file with the payload as 8-bit PCM: lacing kinds take turns, each cluster has a cue."""
    header = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    frames = -(-len(payload) // frame)
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(frames * FRAME_MS))) + element(MUXING_APP, b"cloakframe") + element(WRITING_APP, b"cloakframe"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio)
    parts, cues, at = [info, element(TRACKS, track)], [], 0
    at = sum(map(len, parts))
    span = frame * FRAMES_PER_BLOCK
    for start in range(0, len(payload), span * BLOCKS_PER_CLUSTER):
        time = start // frame * FRAME_MS
        blocks = [number(TIMESTAMP, time)]
        for k, at_byte in enumerate(range(start, min(start + span * BLOCKS_PER_CLUSTER, len(payload)), span)):
            data = payload[at_byte : at_byte + span]
            sizes = [min(frame, len(data) - i) for i in range(0, len(data), frame)]
            kind = 0 if len(sizes) == 1 else 1 + k % 3
            if kind == 2 and sizes[-1] != sizes[0]:
                kind = 3
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at_byte // frame * FRAME_MS - time, 0x80 | kind << 1) + _laces(kind, sizes) + data))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


class Broken(ValueError):
    """The bytes break off or tell an impossible size."""


class Demuxed(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: dict[int, dict]
    clusters: int
    error: str | None


def _size(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length number at ``at`` and the place after it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no length marker at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Broken(f"number breaks off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _children(data: bytes, at: int, end: int, stop: set[int]) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of each element from ``at``; one of unknown size ends at an id of ``stop`` or at ``end``."""
    while at < end:
        ident, body = _size(data, at, True)
        if ident in stop:
            return
        size, body = _size(data, body, False)
        if size < 0:
            if ident not in (SEGMENT, CLUSTER):
                raise Broken(f"unknown size at {at}")
            after = end
            if ident == CLUSTER:
                after = body
                for _, _, after in _children(data, body, end, TOP_LEVEL):  # noqa: B007
                    pass
        else:
            after = body + size
        if after > end:
            raise Broken(f"element at {at} ends beyond {end}")
        yield ident, body, after
        at = after


def _uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _frames(data: bytes, at: int, end: int, kind: int) -> list[int]:
    """Where each frame of a block begins, and the end of the last."""
    if kind == 0:
        return [at, end]
    if at >= end:
        raise Broken(f"lacing breaks off at {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise Broken(f"fixed lacing does not divide at {at}")
        return list(range(at, end, (end - at) // count or 1))[:count] + [end] if end > at else [at] * (count + 1)
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise Broken(f"lacing breaks off at {at}")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            width = 9 - data[at].bit_length() if at < end else 0
            value, at = _size(data, at, False)
            value = (1 << 7 * width) - 1 if value < 0 else value
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        if size < 0:
            raise Broken(f"negative frame size at {at}")
        sizes.append(size)
    starts = [at]
    for size in sizes:
        starts.append(starts[-1] + size)
    if starts[-1] > end:
        raise Broken(f"frames end beyond {end}")
    return [*starts, end]


def demux(data: bytes | None) -> Demuxed:
    """Packets, cues (time in ns, track, cluster's place in the file) and tracks of a Matroska file."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    tracks: dict[int, dict] = {}
    clusters, scale, error = 0, 1_000_000, None
    if data is None:
        return Demuxed(packets, cues, tracks, 0, "null")
    try:
        seen = False
        for ident, start, end in _children(data, 0, len(data), set()):
            if ident == EBML:
                seen = True
            if ident != SEGMENT:
                continue
            for kind, a, b in _children(data, start, end, set()):
                if kind == INFO:
                    for k, x, y in _children(data, a, b, set()):
                        scale = _uint(data, x, y) if k == TIMESTAMP_SCALE else scale
                elif kind == TRACKS:
                    for k, x, y in _children(data, a, b, set()):
                        if k == TRACK_ENTRY:
                            own = {i: data[p:q] for i, p, q in _children(data, x, y, set())}
                            tracks[_uint(own.get(TRACK_NUMBER, b""), 0, 8)] = {"type": _uint(own.get(TRACK_TYPE, b""), 0, 8), "codec": own.get(CODEC_ID, b"").decode("ascii", "replace"), "frame_ns": _uint(own.get(DEFAULT_DURATION, b""), 0, 8)}
                elif kind == CLUSTER:
                    _cluster(data, a, b, scale, clusters, tracks, packets)
                    clusters += 1
                elif kind == CUES:
                    for _, x, y in _children(data, a, b, set()):
                        time, places = 0, []
                        for k, p, q in _children(data, x, y, set()):
                            if k == CUE_TIME:
                                time = _uint(data, p, q)
                            elif k == CUE_POSITIONS:
                                own = {i: _uint(data, s, e) for i, s, e in _children(data, p, q, set())}
                                places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0) + start))
                        cues.extend((time * scale, track, place) for track, place in places)
        if not seen:
            error = "no EBML header"
    except Broken as e:
        error = str(e)
    return Demuxed(packets, cues, tracks, clusters, error)


def _cluster(data: bytes, a: int, b: int, scale: int, cluster: int, tracks: dict, packets: list[Packet]) -> None:
    base = 0
    for k, x, y in _children(data, a, b, set()):
        if k == TIMESTAMP:
            base = _uint(data, x, y)
        elif k == SIMPLE_BLOCK:
            _block(data, x, y, base, scale, cluster, tracks, packets, None)
        elif k == BLOCK_GROUP:
            own = {i: (p, q) for i, p, q in _children(data, x, y, set())}
            if BLOCK in own:
                _block(data, *own[BLOCK], base, scale, cluster, tracks, packets, REFERENCE not in own)


def _block(data: bytes, x: int, y: int, base: int, scale: int, cluster: int, tracks: dict, packets: list[Packet], key: bool | None) -> None:
    track, at = _size(data, x, False)
    if at + 3 > y:
        raise Broken(f"block breaks off at {x}")
    time, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    starts = _frames(data, at + 3, y, kind)
    now, step = (base + time) * scale, tracks.get(track, {}).get("frame_ns", 0)
    key = bool(flags & 0x80) if key is None else key
    name = LACINGS[kind]
    packets.extend(Packet(track, now + i * step, s, e - s, key, name, cluster) for i, (s, e) in enumerate(zip(starts, starts[1:], strict=False)))


def with_media(df: DataFrame, id_col: str, payload: str, media: str = "media") -> DataFrame:
    """``id_col`` and a column with each payload stored as Matroska; a null payload gives a null."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(media, T.BinaryType())])
    return map_rows(df, [id_col, payload], lambda rows: ((k, None if p is None else mux(bytes(p))) for k, p in rows), schema, 64)


def packet_table(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row for each packet of each media value, with its place in the file; damaged files give what came before the damage."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *PACKET.fields])
    return map_rows(df, [id_col, media], lambda rows: ((k, *p) for k, m in rows for p in demux(m).packets), schema, 64)


def read_back(media: bytes | None) -> tuple[bytes, str]:
    """The bytes of all packets in order, and the features of a file as text."""
    found = demux(media)
    payload = b"".join(media[p.offset : p.offset + p.length] for p in found.packets) if media else b""
    laces = dict.fromkeys(LACINGS, 0)
    for p in found.packets:
        laces[p.lacing] += 1
    last = found.packets[-1].timestamp_ns // 1_000_000 if found.packets else 0
    total = len(payload)
    counts = [payload.count(b) for b in (b" ", b"\n", b"e")] if total else [0, 0, 0]
    feature = f"packets={len(found.packets)};clusters={found.clusters};cues={len(found.cues)};last_ms={last};" + ";".join(f"{k}={v}" for k, v in laces.items()) + f";level={sum(payload) / total if total else 0:.6f};spaces={counts[0]};lines={counts[1]};e={counts[2]};error={found.error or ''}"
    return payload, feature


def media_digest(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """Length and hash of each media value and of the payload read from its packets, with features."""
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    )

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, media_bytes in rows:
            payload, feature = read_back(media_bytes)
            stored = media_bytes or b""
            yield key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    return map_rows(df, [id_col, media], make, schema, 64)


def document_media(docs: DataFrame) -> DataFrame:
    """Documents' texts as UTF-8, padded with spaces to a positive multiple of a frame, stored as media.

    A null or empty text is one frame of spaces. The unpadded length travels along in ``n_bytes``.
    """
    schema = T.StructType([T.StructField("key", T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType())])), T.StructField("media", T.BinaryType())])

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            raw = (text or "").encode()
            yield {"doc_id": doc_id, "n_bytes": len(raw)}, mux(raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" "))

    return map_rows(docs, ["doc_id", "text"], make, schema, 64)


def document_digest(docs: DataFrame) -> DataFrame:
    """The stored form of every document, read back: lengths, hashes and features, one row for each input row."""
    out = media_digest(document_media(docs), "key")
    return out.select(F.col("key.doc_id"), F.col("key.n_bytes"), *[c for c in out.columns if c != "key"])
