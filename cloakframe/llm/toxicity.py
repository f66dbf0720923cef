"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of context windows.

From labelled rows the operator learns a lexicon of words and word stems that mark toxic documents. The trie of the
lexicon is intersected with Levenshtein automata (one edit, swaps included, from five characters on, two from ten), and
the product is made deterministic, so that every word of every text is run through its tables in numpy steps. Each hit has a
weight learned for its term and distance. Hits inside quotation marks count apart from the others, whose weights
are summed over windows of words; a logistic model over these figures gives the score.

Words are runs of letters, digits and combining marks of any script; all other characters separate them. Runs of scripts
written without spaces, and any of more than ``RUN`` characters, are no words: terms are learned from all their pieces of 2 to
8 characters, and the automaton begins at each of their characters, which count as words of a window. Words of one or two
letters are no terms. A term must stand out by more than chance would let the best of all those tested.

Labels of at most ``max_labelled`` rows are used (those of least hash); the lexicon holds every term that they show to
mark toxic texts, and the automaton is as many tables as it takes, each run over the distinct words. Scores use the text alone. Defined cases: a null text is scored as an empty one, which has no hits;
without labelled rows of both kinds every score is the share of toxic labels, or 0; rows are scored one by one, so
repeated rows get equal scores; several labels of one document count as one, toxic if any is; columns beside doc_id and
text pass through whatever their names.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, training_rows, written

MAX_LABELLED, WINDOW_WORDS = 20_000, 50
#: A term is so many times likelier in toxic documents than in others, and in so many of them at least.
MIN_ODDS, MIN_DOCS = 20.0, 4
#: Terms of one table; more terms make more tables.
TABLE_TERMS = 16
STEM = (3, 8)
#: Longest run that is one word; lengths of terms from longer ones and from scripts without spaces.
RUN, PIECE = 32, (2, 8)
#: Accidental terms that are let in, as expected over all terms tested.
ACCIDENTS = 1.0
# Fixed ranges of code points: scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
#: Letters that words are told apart by before each is read alone.
HEAD = 3
END = "$"
#: Signs and digits that stand for letters in disguised words.
FOLDED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def letter_of(cp: int) -> str:
    """The letter in lower case, or a space for what stands in no word; letters, digits and marks of all scripts do."""
    c = chr(cp)
    if not c.isalnum() and unicodedata.category(c)[0] != "M":
        return " "
    return c.casefold() if len(c.casefold()) == 1 else c.lower()[:1]


class Letters(dict):
    """``letter_of`` for ``str.translate``, kept for the code points met."""

    def __missing__(self, cp: int) -> str:
        self[cp] = letter_of(cp)
        return self[cp]


LETTERS = Letters()


@lru_cache(1)
def all_letters() -> np.ndarray:
    """Of every code point its letter's, signs read as letters included; 0 for separators."""
    return np.fromiter((0 if (c := FOLDED.get(chr(cp)) or letter_of(cp)) == " " else ord(c) for cp in range(sys.maxunicode + 1)), np.int32, sys.maxunicode + 1)


@lru_cache(1)
def unspaced() -> np.ndarray:
    """Of every code point whether its script is written without spaces."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for a, b in UNSPACED:
        out[a : b + 1] = True
    return out


def edits_allowed(term: str) -> int:
    n = len(term.rstrip(END))
    return 0 if n < 5 else 1 if n < 10 else 2


@dataclass
class Heads:
    """The first ``HEAD`` letters that words share: a word of each, their lengths, and which of them each word has."""

    first: np.ndarray
    lengths: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, columns: np.ndarray, lengths: np.ndarray) -> Heads:
        key = np.zeros(len(lengths), np.int64)
        for column in columns[:HEAD]:
            key = key * 0x110000 + column
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return cls(first, np.minimum(lengths[first], HEAD), which)


@dataclass
class Table:
    """A deterministic table: ``step[state, class]``; state 0 is dead, 1 the start. ``term`` and ``distance`` give each state's term, or -1, and distance at a word's end; ``letters`` its classes, from 2 on."""

    step: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    letters: list[str]
    longest: int

    @classmethod
    def of(cls, terms: list[str]) -> Table:
        """Terms that end in ``$`` are whole words, others stems, which match the beginning of a word."""
        letters = sorted({c for t in terms for c in t.rstrip(END)})
        symbol = {c: k + 2 for k, c in enumerate(letters)}
        children: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}
        stem: dict[int, int] = {}
        limit = [0]
        for k, t in enumerate(terms):
            node, allowed = 0, edits_allowed(t)
            limit[0] = max(limit[0], allowed)
            for c in t.rstrip(END):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    limit.append(0)
                node = children[node][c]
                limit[node] = max(limit[node], allowed)
            (whole if t.endswith(END) else stem)[node] = k
        allowed = [edits_allowed(t) for t in terms]

        def closed(states: set[tuple]) -> frozenset:
            """With skipped letters of terms; a matched stem stays matched, and only the best one is kept."""
            out, todo = set(), list(states)
            while todo:
                s = todo.pop()
                if s in out or s[0] >= 0 and s[1] > limit[s[0]]:
                    continue
                out.add(s)
                if s[0] < 0 or s[2]:
                    continue
                node, e, _ = s
                if node in stem and e <= allowed[stem[node]]:
                    todo.append((-1, e, stem[node]))
                todo.extend((x, e + 1, "") for x in children[node].values())
            matched = sorted((s for s in out if s[0] < 0), key=lambda s: s[1:])
            if matched and matched[0][1] == 0:
                return frozenset(matched[:1])
            return frozenset({s for s in out if s[0] >= 0} | set(matched[:1]))

        def after(state: frozenset, c: str) -> frozenset:
            out: set[tuple] = set()
            for s in state:
                if s[0] < 0:
                    out.add(s)
                    continue
                node, e, waits = s
                if waits:
                    if waits == c:
                        out.add((node, e, ""))
                    continue
                out.add((node, e + 1, ""))
                for x, child in children[node].items():
                    out.add((child, e if x == c else e + 1, ""))
                    if x != c and c in children[child]:
                        out.add((children[child][c], e + 1, x))
            return closed(out)

        start = closed({(0, 0, "")})
        number, todo, rows = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(letters) + 2)}
        while todo:
            state = todo.pop()
            row = [0]
            for c in ["", *letters]:
                to = after(state, c)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows[number[state]] = row
        term, distance = np.full(len(number), -1, np.int32), np.zeros(len(number), np.int32)
        for state, k in number.items():
            ends = [(s[1], s[2]) for s in state if s[0] < 0] + [(s[1], whole[s[0]]) for s in state if s[0] >= 0 and not s[2] and s[0] in whole and s[1] <= allowed[whole[s[0]]]]
            if ends:
                distance[k], term[k] = min(ends)
        step = np.array([rows[k] for k in range(len(number))], np.int32)
        return cls(step, term, distance, letters, max((len(t) for t in terms), default=0) + 2)

    def run(self, columns: np.ndarray, lengths: np.ndarray, own: np.ndarray, heads: Heads) -> np.ndarray:
        """The last state of each word, a column of letters' classes, padded or cut; ``own`` gives this table's class of each.

        The first letters are read once for all words that share them; classes are looked up step by step, for words that
        are still alive, and most die at their second or third letter.
        """
        begun = np.ones(len(heads.first), np.int32)
        live = np.arange(len(heads.first))
        for k in range(min(HEAD, self.longest)):
            live = live[heads.lengths[live] > k]
            begun[live] = self.step[begun[live], own[columns[k][heads.first[live]]]]
            live = live[begun[live] > 0]
        state = begun[heads.which]
        live = np.flatnonzero(state > 0)
        for k in range(HEAD, self.longest):
            live = live[lengths[live] > k]
            if not len(live):
                break
            to = self.step[state[live], own[columns[k][live]]]
            state[live] = to
            live = live[to > 0]
        over = live[lengths[live] > self.longest]
        sticky = (self.step[state[over]] == state[over][:, None])[:, 1:].all(1)
        state[over[~sticky]] = 0
        return state


@dataclass
class Automaton:
    """Tables over groups of ``terms``, with the terms' numbers in each; ``classes`` of code points are those of all letters, and ``own`` gives each table's class of them."""

    terms: list[str]
    tables: list[Table]
    numbers: list[np.ndarray]
    classes: np.ndarray
    own: list[np.ndarray]
    longest: int

    @classmethod
    def of(cls, terms: list[str]) -> Automaton:
        order = sorted(range(len(terms)), key=lambda k: terms[k])
        numbers = [np.array(order[k : k + TABLE_TERMS]) for k in range(0, len(order), TABLE_TERMS)]
        tables = [Table.of([terms[k] for k in group]) for group in numbers]
        letters = sorted({c for t in tables for c in t.letters})
        known = np.ones(sys.maxunicode + 1, np.int32)
        known[0] = 0
        for k, c in enumerate(letters):
            known[ord(c)] = k + 2
        own = [np.array([0, 1, *(t.letters.index(c) + 2 if c in t.letters else 1 for c in letters)], np.int32) for t in tables]
        return cls(terms, tables, numbers, known[all_letters()], own, max((t.longest for t in tables), default=0))

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hits of all texts: text number, word number in it, character, term, distance; and the words of each text."""
        cps = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[cps]
        inside = kind != 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins, ends = every_place(begins, ends, unspaced()[cps])
        words, lengths, which = distinct_words(kind, begins, ends - begins, self.longest)
        columns = np.ascontiguousarray(words.T)
        heads = Heads.of(columns, lengths)
        best = np.full(len(words), np.iinfo(np.int64).max)
        for table, numbers, own in zip(self.tables, self.numbers, self.own, strict=True):
            state = table.run(columns, lengths, own, heads)
            hit = np.flatnonzero(table.term[state] >= 0)
            key = table.distance[state[hit]].astype(np.int64) * len(self.terms) + numbers[table.term[state[hit]]]
            best[hit] = np.minimum(best[hit], key)
        found = best[which]
        hit = np.flatnonzero(found < np.iinfo(np.int64).max)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(begins, at)
        of = np.searchsorted(at, begins[hit], "right") - 1
        distance, term = np.divmod(found[hit], max(1, len(self.terms)))
        return of, hit - first[of], begins[hit] - at[of], term, distance, np.diff(first)


@lru_cache(2)
def automaton_of(terms: tuple[str, ...]) -> Automaton:
    return Automaton.of(list(terms))


def every_place(begins: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs as they are if they are words; of long ones, and of those with characters that stand ``alone``, one run from each character to the end."""
    so_far = np.concatenate(([0], np.cumsum(alone)))
    sizes = ends - begins
    times = np.where((sizes > RUN) | (so_far[ends] > so_far[begins]), sizes, 1)
    if len(times) == times.sum():
        return begins, ends
    first = np.repeat(np.cumsum(times) - times, times)
    return np.repeat(begins, times) + np.arange(len(first)) - first, np.repeat(ends, times)


def distinct_words(kind: np.ndarray, begins: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that differ in their first ``longest`` classes or in being longer, as padded rows, their lengths, and each word's number among them."""
    cut = np.minimum(lengths, longest + 1)
    mixed = np.zeros(len(begins), np.uint64)
    live = np.arange(len(begins))
    for k in range(longest + 1):
        live = live[cut[live] > k]
        value = kind[begins[live] + k] if k < longest else 1
        mixed[live] = (mixed[live] + np.uint64(k + 1) + np.asarray(value).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed[live] ^= mixed[live] >> np.uint64(31)
    _, some, which = np.unique(mixed, return_index=True, return_inverse=True)

    def rows(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chosen), longest), np.int32)
        for k in range(longest):
            on = np.flatnonzero(cut[chosen] > k)
            out[on, k] = kind[begins[chosen[on]] + k]
        return out

    words = rows(some)
    # Two words of one number are told apart by their letters.
    for at in range(0, len(begins), 65_536):
        part = np.arange(at, min(at + 65_536, len(begins)))
        if (cut[part] != cut[some[which[part]]]).any() or (rows(part) != words[which[part]]).any():
            every = np.arange(len(begins))
            return rows(every), cut, every
    return words, cut[some], which


def quoted(text: str, at: int) -> bool:
    """Whether the character stands inside quotation marks that open and close in its line."""
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    before, behind = text[a:at], text[at : len(text) if b < 0 else b]
    if before.count('"') % 2 and '"' in behind:
        return True
    return any(before.rfind(o) > before.rfind(c) and c in behind for o, c in (("“", "”"), ("«", "»"), ("„", "“")))


FEATURES = 4


@dataclass
class Model:
    """Weights of terms at each distance and of the figures of a text."""

    terms: list[str]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    logistic: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    base: float = 0.0
    window: int = WINDOW_WORDS

    def figures(self, automaton: Automaton, texts: list[str]) -> np.ndarray:
        """Of each text: largest weight in a window, log of hits outside and of weight inside quotes, hits per 100 words."""
        out = np.zeros((len(texts), FEATURES))
        of, word, at, term, distance, words = automaton.scan(texts)
        start = 0
        while start < len(of):
            k, end = of[start], start
            spots: list[tuple[int, float]] = []
            inside = 0.0
            while end < len(of) and of[end] == k:
                w = self.weights.get((int(term[end]), int(distance[end])), 0.0)
                if w > 0:
                    if quoted(texts[k], int(at[end])):
                        inside += w
                    else:
                        spots.append((int(word[end]), w))
                end += 1
            best = total = 0.0
            low = 0
            for p, w in spots:
                total += w
                while spots[low][0] <= p - self.window:
                    total -= spots[low][1]
                    low += 1
                best = max(best, total)
            out[k] = best, math.log1p(len(spots)), math.log1p(inside), 100 * len(spots) / max(1, int(words[k]))
            start = end
        return out

    def scores(self, automaton: Automaton, texts: list[str]) -> np.ndarray:
        if not self.terms:
            return np.full(len(texts), self.base)
        z = self.logistic[0] + self.figures(automaton, texts) @ np.array(self.logistic[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``max_labelled`` labelled training rows, those whose id has the least hash."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(training_rows("doc_id", 5)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return written(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")))


def candidates(text: str) -> set[str]:
    """Words, marked as whole, and stems of a text; of runs that are no words, all pieces."""
    runs = {w for w in text.translate(LETTERS).split() if len(w) >= PIECE[0] and not w.isdigit()}
    long = {w for w in runs if len(w) > RUN or not w.isascii() and unspaced()[[ord(c) for c in w]].any()}
    words = {w for w in runs - long if len(w) >= STEM[0]}
    pieces = {w[k : k + n] for w in long for n in range(PIECE[0] if len(w) <= RUN or unspaced()[ord(w[0])] else STEM[0], PIECE[1] + 1) for k in range(len(w) - n + 1)}
    return {w + END for w in words} | {w[:k] for w in words for k in range(STEM[0], min(len(w), STEM[1]) + 1)} | pieces


def learn_lexicon(rows: DataFrame) -> tuple[list[str], int, int]:
    """Terms that mark toxic texts, and the numbers of toxic and other texts."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])

    def count(it: Iterator[tuple]) -> Iterator[tuple]:
        bad: Counter = Counter()
        good: Counter = Counter()
        for text, toxic in it:
            (bad if toxic else good).update(candidates(text))
        yield from ((t, n, good.get(t, 0)) for t, n in bad.items())
        yield from ((t, 0, n) for t, n in good.items() if t not in bad)

    n_toxic, n_other = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n_toxic or not n_other:
        return [], n_toxic, n_other
    sums = map_rows(rows, ["text", "toxic"], count, schema, 8192).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    sums = written(sums.where(F.col("a") + F.col("b") >= MIN_DOCS))
    odds = ((F.col("a") + 0.5) / (n_toxic + 1)) / ((F.col("b") + 0.5) / (n_other + 1))
    # The chance that so many of a term's texts are toxic is at most exp(-n * divergence), by Chernoff's bound.
    n, p = F.col("a") + F.col("b"), n_toxic / (n_toxic + n_other)
    share = F.col("a") / n
    divergence = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0)
    real = n * divergence >= math.log(max(sums.count(), 1) / ACCIDENTS)
    found = {r["term"]: r["a"] for r in sums.where((F.col("a") >= MIN_DOCS) & (odds >= MIN_ODDS) & real).collect()}
    return chosen_terms(found), n_toxic, n_other


def chosen_terms(found: dict[str, int]) -> list[str]:
    """The longest stem or word that keeps nine tenths of a shorter one's texts; what a chosen stem begins is left out."""
    best_longer: dict[str, int] = {}
    for t, a in found.items():
        up = t[:-1]
        best_longer[up] = max(best_longer.get(up, 0), a)
        if unspaced()[ord(t[0])]:
            # A piece may begin anywhere, so one that a longer one ends with is told by that one too.
            best_longer[t[1:]] = max(best_longer.get(t[1:], 0), a)
        if t.endswith(END):
            for k in range(STEM[0], min(STEM[1], len(t) - 2) + 1):
                best_longer[t[:k]] = max(best_longer.get(t[:k], 0), a)
    out: set[str] = set()
    for t in sorted(found, key=lambda t: (len(t.rstrip(END)), t)):
        if best_longer.get(t, 0) >= 0.9 * found[t]:
            continue
        if not any(t[:k] in out for k in range(1, len(t))):
            out.add(t)
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Lexicon, weights and logistic model from labelled training rows."""
    rows = labelled_rows(docs, labels, max_labelled)
    terms, n_toxic, n_other = learn_lexicon(rows)
    model = Model(terms, base=n_toxic / (n_toxic + n_other) if n_toxic + n_other else 0.0)
    if not terms:
        return model
    automaton = automaton_of(tuple(terms))
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])

    def count(it: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for some, marks in _pairs(it):
            of, _, _, term, distance, _ = automaton.scan(some)
            for k, t, d in set(zip(of.tolist(), term.tolist(), distance.tolist(), strict=True)):
                seen[t, d, bool(marks[k])] += 1
        yield from ((t, d, n if bad else 0, 0 if bad else n) for (t, d, bad), n in seen.items())

    hits = map_rows(rows, ["text", "toxic"], count, schema).groupBy("term", "distance").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).collect()
    counts = {(r["term"], r["distance"]): (r["a"], r["b"]) for r in hits}
    for k, t in enumerate(terms):
        for d in range(edits_allowed(t) + 1):
            a, b = counts.get((k, d), (0, 0))
            prior = 2.0 / (1 + d)
            odds = math.log(((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_other + 1))) if a + b >= 3 else prior
            model.weights[k, d] = max(0.0, min(6.0, odds))
    out = T.StructType([T.StructField("toxic", T.IntegerType()), *(T.StructField(f"f{i}", T.DoubleType()) for i in range(FEATURES))])

    def figures(it: Iterator[tuple]) -> Iterator[tuple]:
        for some, marks in _pairs(it):
            for mark, f in zip(marks, model.figures(automaton, some).tolist(), strict=True):
                yield mark, *f

    data = np.array([tuple(r) for r in map_rows(rows, ["text", "toxic"], figures, out).collect()])
    model.logistic = logistic(data[:, 1:], data[:, 0]).tolist()
    return model


def _pairs(it: Iterator[tuple], chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """Rows as two lists, cut so that texts of about ``chars`` characters are scanned at once."""
    texts: list[str] = []
    others: list = []
    size = 0
    for text, other in it:
        texts.append(text or "")
        others.append(other)
        size += len(texts[-1])
        if size >= chars:
            yield texts, others
            texts, others, size = [], [], 0
    if texts:
        yield texts, others


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method on the ridge-penalised logistic loss; the intercept comes first."""
    one = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(one.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        grad = one.T @ (p - y) + penalty * w
        hess = (one * (p * (1 - p))[:, None]).T @ one + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row``, the columns of ``docs``, and ``score`` of each.

    Rows pass through the tasks as Arrow holds them, with their text once; of Python's objects there are the texts of one scan.
    """
    automaton = automaton_of(tuple(model.terms))
    sent = docs.sparkSession.sparkContext.broadcast((model, automaton))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())])
    place = (docs.columns if "text" in docs.columns else [c.lower() for c in docs.columns]).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, automaton = sent.value
        for batch in batches:
            for part in slices(batch, pc.struct_field(batch.column(0), [place])):
                texts = [t or "" for t in pc.struct_field(part.column(0), [place]).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(automaton, texts), pa.float64())], names=["row", "score"])

    return whole.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, texts: pa.Array, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that texts of about ``chars`` characters are scanned at once."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(upto):
        end = min(int(np.searchsorted(upto, before + chars)) + 1, len(upto))
        yield batch.slice(at, end - at)
        at, before = end, int(upto[end - 1])


def score_ids(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted); a document without id is not held out."""
    own = docs.select("doc_id", "text")
    automaton = automaton_of(tuple(model.terms))
    sent = docs.sparkSession.sparkContext.broadcast((model, automaton))
    schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def make(it: Iterator[tuple]) -> Iterator[tuple]:
        model, automaton = sent.value
        for texts, ids in _pairs(it):
            yield from zip(ids, model.scores(automaton, texts).tolist(), strict=True)

    out = map_rows(own, ["text", "doc_id"], make, schema)
    return out.select("doc_id", F.coalesce(~training_rows("doc_id", 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
