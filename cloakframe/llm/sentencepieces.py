"""SentencePiece encoding and decoding by max-plus matrices of chunks.

A text's pieces are the path of the largest sum of scores through the lattice of vocabulary pieces (a unigram search
over the pieces and scores of a public model file; characters without a piece cost ``unknown`` and become byte
pieces). A position's value depends on the ``L`` positions before it, ``L`` being the longest piece, so a stretch of text is
an L x L matrix over (max, +). Giant texts are split into chunks, whose matrices are made independently and combined
associatively: ``BLOCK`` neighbours to one matrix, those to one again, until one is left of each text; on the way back each
block's entering values give those of its members. No task holds more than a block, however long a text is. A map from each
chunk's last cut to its first, combined the same way from the right, lets each chunk be backtraced on its own; counts, sums
and checksums of the parts are joined in blocks too. In other texts a space that follows a non-space is always a cut, and so
is a sign behind a letter or digit, but for the few signs that some piece holds behind one: words decouple, and each distinct
word is searched once per worker. Sums of scores are added up in another order on
the two ways, which shows in the last places unless scores are whole numbers, as those of the default model are.

Among equal sums the longer last piece wins. Defined cases: null and empty texts have no pieces; repeated rows are
encoded each; rows are told apart by position, so doc_id may repeat or be null; columns beside doc_id and text are left
alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, written

SPACE = "▁"
GIANT, CHUNK = 1 << 15, 1 << 13
#: Neighbours that one task combines at each level of a scan.
BLOCK = 64
CACHE_WORDS = 400_000
LOW = -1e300
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")
FORCED = re.compile(f"(?<!{SPACE}){SPACE}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of a model file: pieces with scores, ids and byte pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.scores = {p: float(model.pieces[k].score) for p, k in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        #: What each id stands for in UTF-8; control pieces stand for nothing.
        self.raw = [b""] * len(model.pieces)
        for piece, k in self.ids.items():
            self.raw[k] = piece.encode("utf-8")
        for b, k in self.bytes.items():
            self.raw[k] = bytes([b])
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - 10.0
        self.words_decouple = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: By character: the score of the piece that ends there, if there is one, and what may follow.
        self.trie: dict[str, list] = {}
        for p, score in self.scores.items():
            node, level = None, self.trie
            for c in p:
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = score
        glued = sorted({b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalnum() and not b.isalnum()})
        sign, more = f"(?:[^{SPACE}\\w]|_)", f"(?:[{re.escape(''.join(glued))}]" if glued else ""
        self.part = re.compile(f"{SPACE}*{sign}*(?:[^\\W_]+{f'{more}{sign}*)?' if glued else ''})*")
        self.cache: dict[str, tuple[bytes, float]] = {"": (b"", 0.0)}
        self.parts: dict[str, tuple[bytes, float]] = {}

    def score(self, piece: str) -> float:
        """Score of a stretch as one piece; a single character always has one."""
        found = self.scores.get(piece)
        return found if found is not None else self.unknown if len(piece) == 1 else LOW

    def normalized(self, text: str | None) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def ids_of(self, cuts: list[str]) -> list[int]:
        out: list[int] = []
        for c in cuts:
            own = self.ids.get(c)
            out.extend([own] if own is not None else [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")])
        return out

    def run(self, text: str) -> tuple[list[float], list[int]]:
        """Values and last pieces' lengths of all positions of a text that begins with a cut."""
        n, first, unknown = len(text), self.trie.get, self.unknown
        best, step = [0.0] + [LOW] * n, [0] * (n + 1)
        for at, c in enumerate(text):
            base, node = best[at], first(c)
            s, level = (None, None) if node is None else node
            s = base + (unknown if s is None else s)
            end = at + 1
            if s > best[end]:
                best[end], step[end] = s, 1
            while level and end < n:
                node = level.get(text[end])
                if node is None:
                    break
                end += 1
                s, level = node
                if s is not None and base + s > best[end]:
                    best[end], step[end] = base + s, end - at
        return best, step

    def search(self, text: str) -> tuple[list[str], float]:
        """The best path through one text, position by position."""
        best, step = self.run(text)
        out, at = [], len(text)
        while at:
            out.append(text[at - step[at] : at])
            at -= step[at]
        return out[::-1], best[-1]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian 32-bit ids of a normalized text, and the sum of scores."""
        if not self.words_decouple:
            return self._searched(text)
        words = WORD.findall(text)
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._word(w) if own is None else own for w, own in zip(words, found, strict=True)]
        return b"".join([own[0] for own in found]), sum([own[1] for own in found])

    def _searched(self, text: str) -> tuple[bytes, float]:
        best, step = self.run(text)
        out, at, get = [], len(text), self.ids.get
        while at:
            piece = text[at - step[at] : at]
            own = get(piece)
            if own is not None:
                out.append(own)
            else:
                out.extend(self.ids_of([piece])[::-1])
            at -= step[at]
        return array("I", out[::-1]).tobytes(), best[-1]

    def _word(self, word: str) -> tuple[bytes, float]:
        """A word by its parts between cuts, which many words share."""
        own = self.cache.get(word)
        if own is None:
            parts = self.part.findall(word)
            own = self._part(word) if len(parts) < 3 else tuple(map(add, self._part(parts[0]), self._word("".join(parts[1:]))))
            if len(self.cache) < CACHE_WORDS and len(word) < 64:
                self.cache[word] = own
        return own

    def _part(self, part: str) -> tuple[bytes, float]:
        own = self.parts.get(part)
        if own is None:
            own = self._searched(part)
            if len(self.parts) < CACHE_WORDS and len(part) < 64:
                self.parts[part] = own
        return own

    def decode(self, ids: bytes) -> str:
        """The normalized text of ids; byte pieces that stand together are decoded together."""
        return b"".join(map(self.raw.__getitem__, array("I", ids))).decode("utf-8", "surrogatepass")

    # Chunks. State j at a boundary stands for the position j characters before it.

    def forward(self, before: str, text: str, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and last pieces' lengths of all positions of a chunk, for each column of entering states.

        ``before`` holds the L - 1 characters before the chunk (fewer at a text's beginning). ``enter`` is L x m.
        """
        size, m = self.longest, enter.shape[1]
        whole = before + text
        value = np.full((size + len(text), m), LOW)
        value[:size] = enter[::-1]
        step = np.zeros((size + len(text), m), np.int32)
        for end in range(1, len(text) + 1):
            stop = len(before) + end
            top = value[size + end - 2] + self.score(whole[stop - 1])
            by = np.ones(m, np.int32)
            for k in range(2, min(size, stop) + 1):
                s = self.scores.get(whole[stop - k : stop])
                if s is not None and size + end - 1 - k >= 0:
                    now = value[size + end - 1 - k] + s
                    better = now >= top
                    top = np.where(better, now, top)
                    by = np.where(better, k, by)
            value[size + end - 1] = top
            step[size + end - 1] = by
        return value, step

    def cuts(self, before: str, text: str) -> tuple[int, int] | None:
        """The first and the last place of a chunk that every path cuts: where spaces begin."""
        if not self.words_decouple:
            return None
        found = FORCED.search(text, 0 if before else 1)
        if found and not found.start() and before[-1] == SPACE:
            found = FORCED.search(text, 1)
        if not found:
            return None
        last = len(text) - 1
        while text[last] != SPACE or text[last - 1] == SPACE:
            last -= 1
            if last <= found.start():
                return found.start(), found.start()
        return found.start(), last

    def matrix(self, before: str, text: str) -> np.ndarray:
        """The chunk's transfer matrix: value of leaving state i when entering in state j alone, at 0.

        All paths meet in forced cuts, so that between the first and the last of them one number stands for all.
        """
        size = self.longest
        enter = np.full((size, size), LOW)
        np.fill_diagonal(enter, 0.0)
        forced = self.cuts(before, text)
        if forced is None:
            value, _ = self.forward(before, text, enter)
            return np.maximum(value[::-1][:size], LOW)
        first, last = forced
        head = self.forward(before, text[:first], enter)[0][-1]
        tail = np.full(size, LOW)
        best = self.run(text[last:])[0][::-1][:size]
        tail[: len(best)] = best
        return np.maximum(tail[:, None] + self.encode(text[first:last])[1] + head[None, :], LOW)

    def leaving(self, before: str, text: str, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From entering values: for each leaving state the state it comes from; and the lengths of last pieces.

        With a forced cut inside, all states come from the one that its best path enters by.
        """
        forced = self.cuts(before, text)
        own = text if forced is None else text[: forced[0]]
        _, step = self.forward(before, own, enter[:, None])
        size, n = self.longest, len(own)
        back = np.zeros(size, np.int64)
        for j in range(size if forced is None else 1):
            at = n - j
            while at > 0:
                at -= int(step[size + at - 1, 0])
            back[j] = -at
        return (back if forced is None else np.full(size, back[0])), step[:, 0]

    def backtrace(self, before: str, text: str, enter: np.ndarray, leave: int) -> tuple[bytes, float]:
        """Ids and score of the pieces between a chunk's entering and its leaving cut."""
        _, step = self.leaving(before, text, enter)
        forced = self.cuts(before, text)
        first = len(text) - leave if forced is None else forced[0]
        size, at, out, whole = self.longest, first, [], before + text
        while at > 0:
            k = int(step[size + at - 1])
            out.append(whole[len(before) + at - k : len(before) + at])
            at -= k
        ids, score = np.array(self.ids_of(out[::-1]), np.uint32).tobytes(), sum(map(self.score, out))
        if forced is None:
            return ids, score
        more, plus = self.encode(text[forced[0] : len(text) - leave])
        return ids + more, score + plus


def combined(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The matrix of two chunks in a row; associative."""
    return np.maximum((then[:, :, None] + first[None, :, :]).max(axis=1), LOW)


def applied(matrix: np.ndarray, enter: np.ndarray) -> np.ndarray:
    return np.maximum((matrix + enter[None, :]).max(axis=1), LOW)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


ENCODED = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("round_trip", T.BooleanType()), T.StructField("chunks", T.LongType())])
CHUNKS = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("before", T.StringType()), T.StructField("chunk", T.StringType())])
NUMBERS, PLACES = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
KEY = [T.StructField("row_no", T.LongType()), T.StructField("k", T.LongType())]


def encode_short(docs: DataFrame, path: str) -> DataFrame:
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = loaded(path)
        for row, doc_id, text in rows:
            plain = own.normalized(text)
            ids, score = own.encode(plain)
            yield row, doc_id, len(ids) // 4, zlib.crc32(ids), score, own.decode(ids) == plain, 1

    return map_rows(docs, ["row_no", "doc_id", "text"], make, ENCODED, 256)


def chunks_of(docs: DataFrame, path: str, size: int) -> DataFrame:
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = loaded(path)
        for row, doc_id, text in rows:
            plain = own.normalized(text)
            for k, at in enumerate(range(0, len(plain), size)):
                yield row, doc_id, k, plain[max(0, at - own.longest + 1) : at], plain[at : at + size]

    return map_rows(docs, ["row_no", "doc_id", "text"], make, CHUNKS, 16)


def products(items: DataFrame, combine: Callable, block: int) -> DataFrame:
    """(row_no, k, value) of blocks of neighbours: ``combine`` over ``block`` values in order of k."""
    dealt = items.select("row_no", F.expr(f"k div {block}").alias("block"), "k", "value")
    dealt = dealt.repartition("row_no", "block").sortWithinPartitions("row_no", "block", "k")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = None, None
        for row, b, _, value in rows:
            if now != (row, b):
                if now is not None:
                    yield *now, held
                now, held = (row, b), value
            else:
                held = combine(held, value)
        if now is not None:
            yield *now, held

    return map_rows(dealt, ["row_no", "block", "k", "value"], fold, T.StructType([*KEY, items.schema["value"]]), 64)


def states(items: DataFrame, start: list, combine: Callable, apply: Callable, state: T.DataType, most: int, block: int) -> DataFrame:
    """(row_no, k, state) before each item: ``start`` with all items of the text in front of it applied.

    A parallel scan: products of blocks go up a tree of ``block`` children a node until one node holds a text, then
    states come down. ``most`` is the largest k of all items.
    """
    schema = T.StructType([*KEY, T.StructField("state", state)])
    if most >= block:
        items = written(items)
        above = states(products(items, combine, block), start, combine, apply, state, most // block, block)
    else:
        above = items.sparkSession.createDataFrame([], schema)
    inner = items.select("row_no", F.expr(f"k div {block}").alias("block"), F.lit(1).alias("kind"), "k", "value", F.lit(None).cast(state).alias("state"))
    outer = above.select("row_no", F.col("k").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("k"), F.lit(None).cast(items.schema["value"].dataType).alias("value"), "state")
    dealt = inner.unionByName(outer).repartition("row_no", "block").sortWithinPartitions("row_no", "block", "kind", "k")

    def spread(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = None, start
        for row, b, kind, k, value, given in rows:
            if now != (row, b):
                now, held = (row, b), start
            if not kind:
                held = given
                continue
            yield row, k, held
            held = apply(value, held)

    return map_rows(dealt, ["row_no", "block", "kind", "k", "value", "state"], spread, schema, 64)


def square(flat: list[float]) -> np.ndarray:
    return np.array(flat).reshape(int(len(flat) ** 0.5), -1)


def joined(a: list[float], b: list[float]) -> list[float]:
    """Neighbouring parts as one: pieces, bytes, score, whether all decode, chunks, and the checksum of both."""
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), a[4] + b[4], float(joined_crc32(int(a[5]), int(b[5]), int(b[1])))]


def joined_crc32(a: int, b: int, size: int) -> int:
    """crc32 of two byte strings in a row from theirs, the second of ``size`` bytes: the first moved up by x^(8 size) modulo the polynomial."""
    power, square_, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _times(power, square_)
        square_ = _times(square_, square_)
        n >>= 1
    return _times(power, a) ^ b


def _times(a: int, b: int) -> int:
    """Product of polynomials over two elements, lowest power in the highest bit, modulo that of crc32."""
    out = 0
    while a:
        if a & 1 << 31:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def encode_giant(docs: DataFrame, path: str, size: int, block: int = BLOCK) -> DataFrame:
    """The same as ``encode_short`` by chunks, with a task's work bounded by a block of them."""
    chunks = written(chunks_of(docs, path, size).repartition("row_no", "k"))
    most = chunks.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    longest = loaded(path).longest

    def matrices(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = loaded(path)
        for row, k, before, text in rows:
            yield row, k, own.matrix(before, text).ravel().tolist()

    made = map_rows(chunks, ["row_no", "k", "before", "chunk"], matrices, T.StructType([*KEY, T.StructField("value", NUMBERS)]), 16)
    both = lambda a, b: combined(square(a), square(b)).ravel().tolist()
    entering = states(made, [0.0] + [LOW] * (longest - 1), both, lambda m, s: applied(square(m), np.array(s)).tolist(), NUMBERS, most, block)
    known = written(chunks.join(entering.withColumnRenamed("state", "enter"), ["row_no", "k"]))

    def backs(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = loaded(path)
        for row, k, before, text, enter in rows:
            yield row, most - k, own.leaving(before, text, np.array(enter))[0].tolist()

    # From the right: the last chunk of a text is left at its end, state 0.
    maps = map_rows(known, ["row_no", "k", "before", "chunk", "enter"], backs, T.StructType([*KEY, T.StructField("value", PLACES)]), 16)
    maps = written(maps)
    leaving = states(maps, 0, lambda a, b: [b[x] for x in a], lambda m, s: m[s], T.LongType(), most, block)
    cuts = leaving.join(maps, ["row_no", "k"]).select("row_no", (F.lit(most) - F.col("k")).alias("k"), F.col("state").alias("leave"), F.col("value")[F.col("state").cast("int")].alias("begin"))
    part = T.StructType([*KEY, T.StructField("value", NUMBERS)])

    def trace(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = loaded(path)
        for row, k, before, text, enter, leave, begin in rows:
            ids, score = own.backtrace(before, text, np.array(enter), leave)
            whole = (before + text)[len(before) - begin : len(before) + len(text) - leave]
            yield row, k, [len(ids) // 4, len(ids), score, float(own.decode(ids) == whole), 1, zlib.crc32(ids)]

    parts = map_rows(known.join(cuts, ["row_no", "k"]), ["row_no", "k", "before", "chunk", "enter", "leave", "begin"], trace, part, 16)
    while most >= block:
        parts, most = products(parts, joined, block), most // block
    whole = products(parts, joined, block)
    v = [F.col("value")[i] for i in range(6)]
    own = whole.select("row_no", v[0].cast("long").alias("n_pieces"), v[5].cast("long").alias("ids_crc32"), v[2].alias("score"), (v[3] == 1).alias("round_trip"), v[4].cast("long").alias("chunks"))
    return own.join(chunks.where("k = 0").select("row_no", "doc_id"), "row_no").select(*ENCODED.names)


def encode_documents(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Pieces of every document: their number, a checksum of the ids, the sum of scores, and whether decoding gives the text back."""
    path = model or default_model()
    numbered = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    out = encode_short(numbered.where(~long), path).unionByName(encode_giant(numbered.where(long), path, chunk, block))
    return out.drop("row_no")
