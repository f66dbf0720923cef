"""Small builders of Spark SQL text; expressions made this way are parsed once by Spark and stay native."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_NAMES = count()


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body) -> str:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    v = f"v{next(_NAMES)}"
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def weighted(s: str, weights: list[int], start: int = 1) -> str:
    """Sum of digits of ``s`` from place ``start`` times weights."""
    return "(" + " + ".join(f"{w} * cast(substring({s}, {k + start}, 1) as int)" for k, w in enumerate(weights)) + ")"


FOUND = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
WINDOW = 60
#: Neighbours that fill a window, each being four characters long at least.
NEAR = 15


def begins(steps: str, levels: int = 3) -> str:
    """Running sums of an array of numbers, each without its own term: by blocks of 8, whose own beginnings come from their sums in the same way.

    With no levels there are blocks of 64 alone: a shorter text for plans that hold it once for each rule.
    """
    total = lambda x: f"aggregate({x}, 0, (a, x) -> a + x)"
    size = 8 if levels else 64
    sums = f"transform(sequence(0, (size({steps}) - 1) div {size}), b -> {total(f'slice({steps}, b * {size} + 1, {size})')})"
    if not levels:
        return let(sums, lambda own: f"flatten(transform(sequence(0, (size({steps}) - 1) div 64), b -> transform(slice({steps}, b * 64 + 1, 64), (_, j) -> {total(f'slice({own}, 1, b)')} + {total(f'slice({steps}, b * 64 + 1, j)')})))")
    block = lambda part: f"transform({part}, (_, j) -> if(j = 0, o, aggregate(slice({part}, 1, j), o, (a, x) -> a + x)))"
    inner = lambda own: f"flatten(transform({begins(own, levels - 1)}, (o, b) -> {let(f'slice({steps}, b * {size} + 1, {size})', block)}))"
    return let(sums, inner)


def places(text: str, pattern: str) -> str:
    """array<struct<start,end,m>> of all leftmost matches; positions count code points."""

    def of(m: str, gaps: str) -> str:
        steps = f"transform({m}, (m, i) -> length(m) + length({gaps}[i]))"
        return let(let(steps, begins), lambda at: f"transform({m}, (m, i) -> named_struct('start', {at}[i] + length({gaps}[i]), 'end', {at}[i] + length({gaps}[i]) + length(m), 'm', m))")

    none = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    return let(f"regexp_extract_all({text}, {lit(pattern)}, 0)", lambda m: f"if(size({m}) > 0, {let(f'split({text}, {lit(pattern)}, -1)', lambda g: of(m, g))}, {none})")


def placed(gaps: str, matches: str) -> str:
    """Spans of matches from what lies between them: ``gaps`` has one more than ``matches``.

    What stands around a match is put together from its ``NEAR`` neighbours on each side, not cut from the text, whose
    places would have to be counted anew for each.
    """
    steps = f"transform({matches}, (m, i) -> length(m) + length({gaps}[i]))"
    # Of each gap and the match behind it the end, of each match and the gap behind it the beginning.
    left = f"transform({matches}, (m, i) -> right(concat(right({gaps}[i], {WINDOW}), m), {WINDOW}))"
    right = f"transform({matches}, (m, i) -> left(concat(m, left({gaps}[i + 1], {WINDOW})), {WINDOW}))"

    def span(at: str, ls: str, rs: str) -> str:
        before = f"if(length({gaps}[i]) >= {WINDOW}, right({gaps}[i], {WINDOW}), right(concat(array_join(slice({ls}, greatest(i - {NEAR}, 0) + 1, least(i, {NEAR})), ''), {gaps}[i]), {WINDOW}))"
        after = f"if(length({gaps}[i + 1]) >= {WINDOW}, left({gaps}[i + 1], {WINDOW}), left(concat({gaps}[i + 1], array_join(slice({rs}, i + 2, {NEAR}), '')), {WINDOW}))"
        return f"transform({matches}, (m, i) -> named_struct('start', {at}[i] + length({gaps}[i]), 'end', {at}[i] + length({gaps}[i]) + length(m), 'm', m, 'before', {before}, 'after', {after}))"

    return let(steps, lambda s: let(begins(s, 0), lambda at: let(left, lambda ls: let(right, lambda rs: span(at, ls, rs)))))


def spans(text: str, pattern: str, check: Callable[[str], str] | None = None) -> str:
    """array<struct<start,end,m,before,after>> of all leftmost matches; positions count code points.

    The text is read once; only one with a match (that passes ``check``, if given) is read again, for what lies between.
    """
    p = lit(pattern)

    def of(m: str) -> str:
        some = f"exists({m}, s -> {check('s')})" if check else f"size({m}) > 0"
        gaps = f"split({text}, {p}, -1)"
        return f"if({some}, {let(gaps, lambda g: placed(g, m))}, cast(array() as {FOUND}))"

    return let(f"regexp_extract_all({text}, {p}, 0)", of)
