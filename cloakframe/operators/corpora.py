"""Labelled and tagged texts made from the rows of a table by a weighted grammar.

A grammar gives each symbol its templates, each with a weight; ``{symbol}`` in a template stands for one of that symbol's
templates, to any depth, ``{EMAIL}`` and other types for a fake value, ``{!IBAN}`` for a near miss whose check digit is
wrong, and ``{=name}`` for a value of the row itself. The grammar is expanded once to flat templates with the products of
their weights, of which a row takes one by an alias table: one draw, whatever the number of templates. Places of values
are sums of the lengths before them, so spans hold through all nesting.

Defined cases: the same key, seed and grammar give the same text; repeated rows give it again; a row's own value that is
null or empty is no span; a symbol without templates, one that contains itself, or more than ``MOST`` flat templates are
errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let, lit
from .synthetic import fake_sql, number

#: Flat templates of a grammar at most.
MOST = 2000
SPANS = "array<struct<start:int,end:int,entity_type:string,text:string,hard:boolean>>"
Grammar = dict[str, list[tuple[float, str]]]
_SLOT = re.compile(r"\{([^{}]*)\}")
#: Parts of a unit that the second draw of an alias table tells apart.
FINE = 1 << 20


def expanded(grammar: Grammar, start: str = "start") -> list[tuple[float, list[str], list[str]]]:
    """(weight, texts, slots) of all flat templates; there is one text more than slots."""

    def of(symbol: str, above: tuple[str, ...]) -> list[tuple[float, list[str], list[str]]]:
        if symbol in above:
            raise ValueError(f"{symbol!r} contains itself")
        if not grammar[symbol]:
            raise ValueError(f"{symbol!r} has no templates")
        total = sum(w for w, _ in grammar[symbol])
        out = []
        for weight, template in grammar[symbol]:
            cut = _SLOT.split(template)
            inner = [of(name, (*above, symbol)) if name in grammar else [(1.0, ["", ""], [name])] for name in cut[1::2]]
            for chosen in product(*inner):
                share, texts, slots = weight / total, [cut[0]], []
                for (w, ts, own), behind in zip(chosen, cut[2::2], strict=True):
                    share *= w
                    texts[-1] += ts[0]
                    texts += ts[1:]
                    texts[-1] += behind
                    slots += own
                out.append((share, texts, slots))
                if len(out) > MOST:
                    raise ValueError(f"{symbol!r} has more than {MOST} templates")
        return out

    return of(start, ())


def alias_table(weights: list[float]) -> list[tuple[int, int]]:
    """(mark, other) for each item: of ``FINE`` parts of its share those below the mark are its own, the rest another's."""
    n, total = len(weights), sum(weights)
    left = [w * n / total for w in weights]
    out = [(FINE, k) for k in range(n)]
    small = [k for k in range(n) if left[k] < 1]
    large = [k for k in range(n) if left[k] >= 1]
    while small and large:
        s, g = small.pop(), large.pop()
        out[s] = (round(left[s] * FINE), g)
        left[g] += left[s] - 1
        (small if left[g] < 1 else large).append(g)
    return out


def broken(value: str) -> str:
    """SQL text of a value with another last digit, which no check of a last digit passes."""
    return let(value, lambda v: f"regexp_replace({v}, '[0-9](?=[^0-9]*$)', cast((cast(regexp_extract({v}, '([0-9])[^0-9]*$', 1) as int) + 1) % 10 as string))")


def labelled(rows: DataFrame, key: str, grammar: Grammar, seed: int = 42, country: str = "FR", own: dict[str, tuple[str, str]] | None = None, draw: Callable[[str, int], str] | None = None) -> DataFrame:
    """``rows`` with ``text`` and ``spans``, an array of (start, end, entity_type, text, hard).

    ``own`` gives the entity type and SQL of values of the row, by the name behind =; ``draw`` the SQL of a number below a
    bound for a tag, by default a hash of seed, tag and key.
    """
    own = own or {}
    draw = draw or (lambda tag, below: number(key, seed, tag, below))
    flat = expanded(grammar)
    marks = alias_table([w for w, _, _ in flat])
    kinds = sorted({s.lstrip("!") for _, _, slots in flat for s in slots if not s.startswith("=")})
    names = sorted({s[1:] for _, _, slots in flat for s in slots if s.startswith("=")})
    slot_key = f"concat(cast({key} as string), ':', cast(i as string))"
    fakes = " ".join(f"when {lit(k)} then {fake_sql(k, slot_key, seed, country)}" for k in kinds)
    bare = "if(s like '!%', substring(s, 2), s)"
    value = f"case {bare} {fakes} end" if kinds else "cast(null as string)"
    mine = "case s " + " ".join(f"when {lit('=' + n)} then coalesce(cast({own[n][1]} as string), '')" for n in names) + " end" if names else "cast(null as string)"
    types = "case s " + " ".join(f"when {lit('=' + n)} then {lit(own[n][0])}" for n in names) + f" else {bare} end" if names else bare
    filled = f"transform(__t.slots, (s, i) -> named_struct('type', {types}, 'hard', s like '!%', 'v', if(s like '=%', {mine}, if(s like '!%', {broken(value)}, {value}))))"
    table = ", ".join(f"named_struct('texts', array({', '.join(map(lit, ts))}), 'slots', {'array(' + ', '.join(map(lit, slots)) + ')' if slots else 'cast(array() as array<string>)'})" for _, ts, slots in flat)
    alias = ", ".join(f"named_struct('mark', {m}, 'other', {o})" for m, o in marks)
    at = let(f"cast({draw('template', len(flat))} as int)", lambda k: f"if({draw('share', FINE)} < array({alias})[{k}].mark, {k}, array({alias})[{k}].other)")
    out = rows.withColumn("__t", F.expr(f"array({table})[{at}]")).withColumn("__v", F.expr(filled))
    text = "concat(__t.texts[0], array_join(transform(__v, (x, i) -> concat(x.v, __t.texts[i + 1])), ''))"
    start = "length(__t.texts[0]) + aggregate(sequence(0, i), 0, (a, k) -> a + if(k = i, 0, length(__v[k].v) + length(__t.texts[k + 1])))"
    spans = f"filter(transform(__v, (x, i) -> named_struct('start', {start}, 'end', {start} + length(x.v), 'entity_type', x.type, 'text', x.v, 'hard', x.hard)), x -> x.text <> '')"
    return out.withColumn("text", F.expr(text)).withColumn("spans", F.expr(f"cast({spans} as {SPANS})")).drop("__t", "__v")


def tagged(corpus: DataFrame) -> DataFrame:
    """``corpus`` with ``tokens`` and ``ner_tags``: words, and IOB tags of those that touch a span which is no near miss."""
    from .evaluation import tokens

    tag = let("get(filter(spans, s -> not s.hard and w.start < s.end and s.start < w.end), 0)", lambda s: f"if({s} is null, 'O', concat(if(w.start <= {s}.start, 'B-', 'I-'), {s}.entity_type))")
    words = corpus.withColumn("__words", tokens("text"))
    return words.withColumn("tokens", F.expr("transform(__words, w -> w.m)")).withColumn("ner_tags", F.expr(f"transform(__words, w -> {tag})")).drop("__words")


def found_spans(corpus: DataFrame, entities: str = "entities") -> DataFrame:
    """``corpus`` with ``labelled``, ``found`` and ``misled``: how many spans there are, how many entities of their type stand exactly there, and how many near misses were taken for what they are not."""
    at = f"exists({entities}, e -> e.start = s.start and e.end = s.end and e.entity_type = s.entity_type)"
    return corpus.withColumn("labelled", F.expr("size(filter(spans, s -> not s.hard))")).withColumn("found", F.expr(f"size(filter(spans, s -> not s.hard and {at}))")).withColumn("misled", F.expr(f"size(filter(spans, s -> s.hard and {at}))"))
