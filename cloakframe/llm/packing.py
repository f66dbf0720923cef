"""Cost-balanced packing: token ids of documents cut and dealt to sequences of one length.

A document's cost in a sequence is estimated as a linear plus a quadratic (attention) term of its tokens. Documents
are taken in descending order and each goes to the lowest-cost sequence with remaining token capacity: of those that
hold it whole if there are any, else it is cut at the end of the lowest-cost one and its rest is taken up again.

Tokens come from a public vocabulary file of the ``tokenizers`` library. Texts of plain Latin characters are split at
white space and each distinct word is encoded once per worker; any other text is encoded by the library as a whole.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties in length go by id, then
by the order read. Work is per partition, in windows of ``WINDOW`` tokens, so memory is bounded and nothing is
shuffled; at most one sequence per window stays partly filled. Other columns of the input are left alone.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

LENGTH, END_ID, WINDOW = 2048, 1, 4_000_000
#: Weights of a piece's tokens and of their square, in the proportion of a 2048-wide model's projections and attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Words and their parts kept in a worker's cache, which lasts as long as the worker; characters encoded at once.
CACHE_WORDS, BATCH_CHARS = 1 << 17, 1_000_000

#: Texts of these characters alone are normalized by lower() and never split inside a white-space word but by WORD.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įı-ɏ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts under a word-level byte-pair vocabulary, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split, level]}}
        self.words = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.special = [t["content"] for t in spec["added_tokens"]] or [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: Of words and of their parts alike: a part is cut no further, so as a word it has the same ids.
        self.cache: dict[str, bytes] = {}
        self.room = cache_words

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the cache; kept there while it has room."""
        found, parts = {}, {}
        new = [(w, self._parts(w)) for w in words]
        fresh = list({p for _, own in new for p in own if p not in self.cache})
        for at in range(0, len(fresh), 256):
            some = fresh[at : at + 256]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, before = ids.tobytes(), 0
                for p, cut in zip(some, cuts.tolist(), strict=True):
                    parts[p] = raw[4 * before : 4 * cut]
                    before = cut
            else:
                parts |= {p: np.array(self.words.encode(p, add_special_tokens=False).ids, np.uint32).tobytes() for p in some}
        for w, own in new:
            found[w] = b"".join([parts[p] if p in parts else self.cache[p] for p in own])
        for new in (parts, found):
            self.cache |= islice(new.items(), max(0, self.room - len(self.cache)))
        return found

    @staticmethod
    def _parts(word: str) -> list[str]:
        """What the vocabulary's own pattern cuts a lower-case word into."""
        return [word] if word.isalpha() else WORD.findall(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens."""
        split = [t.lower().split() if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        get = self.cache.get
        ids = [None if s is None else list(map(get, s)) for s in split]
        gaps = [[k for k, x in enumerate(own) if x is None] if own is not None and None in own else () for own in ids]
        new = self.learn({s[k] for s, own in zip(split, gaps, strict=True) for k in own})
        for s, own, gap in zip(split, ids, gaps, strict=True):
            for k in gap:
                own[k] = new[s[k]]
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() if own is None else b"".join(own) for t, own in zip(texts, ids, strict=True)]


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) for documents of these lengths, in the fewest sequences.

    As many sequences are opened as the tokens fill. Pieces are taken longest first; each goes to the lowest-cost
    sequence that still holds it whole, whatever its room; of equal ones to that with the least room, then to the first. What fits nowhere whole is cut at the end
    of the lowest-cost sequence with any room, and its rest is taken up again in its turn. Pieces of the full length
    come first and fit empty sequences only, which cost nothing, so they are dealt without a search.
    """
    out: list[tuple[int, int, int, int, int]] = []
    queue, made = [], 0
    for doc, n in enumerate(lengths):
        whole = n // length
        out.extend((doc, k * length, length, made + k, 0) for k in range(whole))
        made += whole
        if n % length:
            queue.append((-(n % length), doc, whole * length))
    heapq.heapify(queue)
    open_ = Open(-(-sum(-q[0] for q in queue) // length), length)
    while queue:
        size, doc, start = heapq.heappop(queue)
        n = take = -size
        if not open_.holds(n):
            take = open_.room_of_cheapest()
            heapq.heappush(queue, (take - n, doc, start + take))
        sequence, offset = open_.place(take)
        out.append((doc, start, take, made + sequence, offset))
    return out


class Open:
    """Sequences by room left: a heap by cost for each room, and the least cost of every room in one array."""

    def __init__(self, bins: int, length: int) -> None:
        self.length = length
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.least = np.full(length + 1, np.inf)
        if bins:
            self.heaps[length], self.least[length] = [(0.0, b) for b in range(bins)], 0.0

    def _cheapest(self, n: int) -> int:
        """The room of the lowest-cost sequence with ``n`` tokens of it; the least of equal ones."""
        return n + int(self.least[n:].argmin())

    def holds(self, n: int) -> bool:
        return self.least[self._cheapest(n)] < np.inf

    def room_of_cheapest(self) -> int:
        return self._cheapest(1)

    def place(self, n: int) -> tuple[int, int]:
        """Puts ``n`` tokens into the lowest-cost sequence with room for them: its number and the place in it."""
        room = self._cheapest(n)
        spent, b = heapq.heappop(self.heaps[room])
        self._see(room)
        if room > n:
            heapq.heappush(self.heaps[room - n], (spent + cost(n), b))
            self._see(room - n)
        return b, self.length - room

    def _see(self, room: int) -> None:
        self.least[room] = self.heaps[room][0][0] if self.heaps[room] else np.inf


PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, and a checksum of its ids.

    ``sequence_id`` is the partition's number times 2**32 plus a count, so it is unique and the same when a lost task
    is run again.
    """
    path = vocabulary or default_vocabulary()

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        end = end_id.to_bytes(4, "little")
        first = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for some in _windows(rows, encoder, end, window):
            pieces = pack([len(ids) // 4 for _, ids in some], length)
            for doc, start, n, sequence, offset in pieces:
                doc_id, ids = some[doc]
                yield doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, first + sequence, offset
            first += max((p[3] for p in pieces), default=-1) + 1

    return map_rows(docs, ["doc_id", "text"], make, PIECE)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process; its word cache serves the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _windows(rows: Iterator[tuple], encoder: Encoder, end: bytes, window: int) -> Iterator[list[tuple[int, bytes]]]:
    held: list[tuple[int, bytes]] = []
    tokens, batch, chars = 0, [], 0
    def drained() -> int:
        ids = encoder.encode([t or "" for _, t in batch])
        held.extend((k, x + end) for (k, _), x in zip(batch, ids, strict=True))
        return sum(len(x) // 4 + 1 for x in ids)
    for row in rows:
        batch.append(row)
        chars += len(row[1] or "")
        if chars >= BATCH_CHARS:
            tokens += drained()
            batch, chars = [], 0
            if tokens >= window:
                yield held
                held, tokens = [], 0
    if batch:
        drained()
    if held:
        yield held
