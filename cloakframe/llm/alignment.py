"""Alignment of two tokenizers over the same bytes: groups between common boundaries, links of overlapping tokens, their corpus counts.

Python encodes each text twice and marks the bytes at which a token of either side ends, some texts at a time in numpy steps:
marks of both sides cut the tokens into groups, and each mark of any side ends one link, that of the two tokens behind it, so
that time is linear in a text. Spark explodes the links and counts them over the corpus by pair of ids. The most frequent
pairs, ``HELD`` at most, are held by all tasks; documents meet the others, none of which makes up much of all links, by a
join on the pair.

A text of single spaces and line ends is encoded word by word, each distinct word once a worker: neither vocabulary has a
token that reaches over the space or line end before a word. Any other text is encoded as a whole.

Defined cases: null and empty texts, and those whose joined tokens are not a space and the text in either vocabulary (the
one of pieces takes U+2581 for a space, say), have no tokens: zeros and an empty digest. Repeated rows count each. Ties for
a B id's highest count are all best. An empty table gives no rows. Other columns of the input are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most pairs held by all tasks.
HELD = 1 << 18
#: Words kept in a worker's cache and the longest of them, the rows taken at a time, the new words encoded in one text, and the bits of an id.
CACHE_WORDS, LONGEST, ROWS, TOGETHER, ID_BITS = 300_000, 32, 256, 1000, 17
#: Tokens aligned at a time, if they are not of one text.
ALIGNED = 500_000
#: White space other than spaces and line ends.
_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
ALIGNMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"


def default_vocabularies() -> tuple[str, str, str]:
    """Ranks of the byte vocabulary (the same ids as its JSON), its splitting pattern, and the model of pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def odd_space(text: str) -> bool:
    """Whether white space is more than a space, or one or two line ends, between two other characters, or stands at an end."""
    if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text:
        return True
    ascii_ = text.isascii()
    return any(c in text for c in _OTHER_SPACE if not ascii_ or c < "\x80")


class Pair:
    """Both tokenizers; a token is a little-endian 32-bit integer, its byte length above the ``ID_BITS`` bits of its id."""

    def __init__(self, ranks: str, pattern: str, pieces: str, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_size = np.zeros(max(known.values()) + 1, np.uint32)
        self.a_size[list(known.values())] = [len(t) for t in known]
        size = self.b.get_piece_size()
        names = self.b.id_to_piece(list(range(size)))
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.uint32)
        # Words can be encoded alone only if no piece has a space behind another character.
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.room = cache_words

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Tokens under both; None where the pieces' bytes are not a space and the text."""
        want = b" " + text.encode()
        b = self.b.encode(text, num_threads=1)
        if b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        a = np.array(self.a.encode_ordinary(" " + text), np.uint32)
        if int(self.a_size[a].sum()) != len(want):
            return None
        b = np.array(b, np.uint32)
        return (a | self.a_size[a] << ID_BITS).tobytes(), (b | self.b_size[b] << ID_BITS).tobytes()

    def _words(self, words: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Tokens of each of these words as they stand behind another, encoded in two texts if these keep their bytes."""
        out: dict[str, tuple[bytes, bytes] | None] = {}
        for own, joined in ((x := [w for w in words if w[0] != "\n"], "x " + " ".join(x)), (x := [w for w in words if w[0] == "\n"], "x" + "".join(x))):
            found = self._whole(joined) if own else None
            if found is None:
                out |= {w: self._alone(w) for w in own}
                continue
            stops = np.cumsum([2, *(len(w.encode()) + (w[0] != "\n") for w in own)])
            parts = []
            for x in found:
                cuts = (4 * (np.searchsorted(np.cumsum(np.frombuffer(x, np.uint32) >> ID_BITS), stops) + 1)).tolist()
                parts.append([x[i:j] for i, j in zip(cuts, cuts[1:])])
            out |= dict(zip(own, zip(*parts, strict=True), strict=True))
        return out

    def _alone(self, word: str) -> tuple[bytes, bytes] | None:
        """Tokens of a word behind an x, without those of the x."""
        found = self._whole(f"x{word}" if word[0] == "\n" else f"x {word}")
        return None if found is None else tuple(x[4 * (int(np.searchsorted(np.cumsum(np.frombuffer(x, np.uint32) >> ID_BITS), 2)) + 1) :] for x in found)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        plain = [f"{t}".replace("\n", " \n").split(" ") if t and self.apart and not odd_space(t) else None for t in texts]
        get = self.cache.get
        held = [None if words is None else list(map(get, words)) for words in plain]
        new = list({w for words, own in zip(plain, held, strict=True) if own and None in own for w, x in zip(words, own, strict=True) if x is None})
        found: dict = {}
        for at in range(0, len(new), TOGETHER):
            found |= self._words(new[at : at + TOGETHER])
        if len(self.cache) < self.room:
            self.cache |= {w: x for w, x in found.items() if x is not None and len(w) <= LONGEST}
        out = []
        for text, words, own in zip(texts, plain, held, strict=True):
            if own is None:
                out.append(self._whole(text) if text else None)
                continue
            if None in own:
                own = [found.get(w) if x is None else x for w, x in zip(words, own, strict=True)]
            out.append(None if None in own else (b"".join([x[0] for x in own]), b"".join([x[1] for x in own])))
        return out


@lru_cache(1)
def pair_of(files: tuple[str, str, str]) -> Pair:
    """One pair of tokenizers, with its cache, for all tasks of a worker."""
    return Pair(*files)


@lru_cache(1)
def digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each id as the first bytes of eight, the others zero, and how many bits they take."""
    texts = [b"%d" % k for k in range(1 << ID_BITS)]
    return np.array(texts, "S8").view("<u8"), np.array([8 * len(x) for x in texts], "<u8")


def aligned(found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """For texts' tokens under both vocabularies: numbers of A and B tokens, groups and links, digests, and all links' pairs of ids."""
    n_a, n_b = (np.array([len(x[side]) // 4 for x in found], np.int64) for side in (0, 1))
    a, b = (np.frombuffer(b"".join([x[side] for x in found]), "<u4") for side in (0, 1))
    # Both sides of a text have as many bytes, so positions may run on over all texts.
    a_ends, b_ends = np.cumsum(a >> ID_BITS, dtype=np.int64), np.cumsum(b >> ID_BITS, dtype=np.int64)
    a, b = a & ((1 << ID_BITS) - 1), b & ((1 << ID_BITS) - 1)
    marks = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] |= 2
    marks = marks[np.flatnonzero(marks)]
    # The tokens that a link joins are those whose ends have not yet passed.
    of_a, of_b = np.cumsum(marks & 1, dtype=np.int64) - (marks & 1), np.cumsum(marks >> 1, dtype=np.int64) - (marks >> 1)
    pairs = a[of_a].astype(np.int64) << 32 | b[of_b]
    both = np.flatnonzero(marks == 3)
    # Tokens of each side up to the end of each group, and groups and links up to the end of each text.
    to_a, to_b = of_a[both] + 1, of_b[both] + 1
    texts = np.searchsorted(to_a, np.cumsum(n_a), "right")
    links = np.concatenate(([0], both + 1))[texts]
    return n_a, n_b, np.diff(texts, prepend=0), np.diff(links, prepend=0), _digests(a, b, to_a, to_b, np.cumsum(n_a + n_b)), pairs


def _digests(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, texts: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text: ids in order of groups, A's before B's, each with the sign behind it."""
    ids = np.empty(len(a) + len(b), np.int64)
    signs = np.full(len(ids), ord(","), "<u8")
    at_a = np.arange(len(a)) + np.repeat(np.concatenate(([0], to_b))[:-1], np.diff(to_a, prepend=0))
    at_b = np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))
    ids[at_a], ids[at_b] = a, b
    signs[at_a[to_a - 1]], signs[at_b[to_b - 1]] = ord("|"), ord(";")
    names, sizes = digits()
    cells = names[ids] | signs << sizes[ids]
    return [hashlib.sha256(cells[i:j].tobytes().translate(None, b"\0")[:-1]).hexdigest() if i < j else "" for i, j in zip([0, *texts.tolist()], texts.tolist())]


def _cut(found: list[tuple[bytes, bytes]]) -> Iterator[slice]:
    """Stretches of texts with ``ALIGNED`` tokens at most, or of one text."""
    first, size = 0, 0
    for k, (a, b) in enumerate(found):
        own = (len(a) + len(b)) // 4
        if k > first and size + own > ALIGNED:
            yield slice(first, k)
            first, size = k, 0
        size += own
    if first < len(found):
        yield slice(first, len(found))


def alignments(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """``ALIGNMENTS`` of each row of ``docs``; a pair is the A id above the 32 bits of the B id, and there is one a link."""
    files = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [x or (b"", b"") for x in pair.encode(part.column(1).to_pylist())]
                for some in _cut(found):
                    *numbers, links, digests, pairs = aligned(found[some])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(links))).astype(np.int32)), pa.array(pairs))
                    columns = [part.column(0)[some], *map(pa.array, (*numbers, links)), pa.array(digests, pa.string()), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNMENTS)


def linked(found: DataFrame) -> DataFrame:
    """One row a link of ``ALIGNMENTS``: ``row``, ``pair`` and on a document's first row its ``doc``.

    A document without tokens has one row without a pair.
    """
    doc = F.struct("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    # The generator must stand behind the number, or it counts links.
    out = found.withColumn("row", F.monotonically_increasing_id()).select("row", doc.alias("doc"), F.posexplode_outer("pairs").alias("nth", "pair"))
    return out.select("row", "pair", F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("doc")).alias("doc"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold a pair of ids, and whether no pair of its B id is held by more."""
    counts = written(links.where("pair is not null").groupBy("pair").agg(F.count("*").alias("n")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    # One row for each id of the vocabulary at most.
    return written(counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def held_from(counts: DataFrame) -> tuple[int, bool]:
    """The least count, a power of 2, that no more than ``HELD`` pairs reach, and whether some pairs do not reach it."""
    bits = {r["bits"]: r["count"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}
    least, held = max(bits, default=0) + 1, 0
    while least - 1 in range(1, 65) and held + bits.get(least - 1, 0) <= HELD:
        least -= 1
        held += bits.get(least, 0)
    return 1 << (least - 1), held < sum(bits.values())


def align(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """Per document the numbers of tokens, groups and links, digests, and what its links count over the corpus."""
    links = written(linked(alignments(docs, vocabularies)))
    counts = pair_counts(links)
    least, more = held_from(counts)
    hot = F.broadcast(counts.where(F.col("n") >= least))
    own = links.where("pair is not null").select("row", "pair")
    sums = own.join(hot, "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    if more:
        # No pair of these makes up more than a small share of all links.
        rare = own.join(hot.select("pair"), "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
        rare = rare.join(counts.where(F.col("n") < least), "pair")
        more_sums = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = sums.unionByName(more_sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = links.where("doc is not null").select("row", "doc.*").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
