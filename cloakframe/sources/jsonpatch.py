"""Texts changed inside JSON bodies without touching anything else of them.

A body is cut at the string values that a chat's or completion's schema calls texts: what lies between is kept as it
stands, byte for byte, unknown fields, numbers and spaces included; texts are changed by SQL and put back as JSON strings.
A text that the change leaves alone keeps its own spelling, so the identity gives the body back.

Defined cases: a body that is null or no JSON object gives null; one without texts stays as it is; of keys that repeat in
an object the last counts; contents that are neither strings nor lists stay as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import let

CUT = "pieces array<string>, raws array<string>, texts array<string>"
_SPACE = re.compile(r"[ \t\n\r]*")
_OTHER = re.compile(r"[^\s,\]}]+")
#: Where texts are, by kind of body: paths of keys; * stands for each item of a list.
PATHS = {
    "messages": (("messages", "*", "content"), ("messages", "*", "content", "*", "text")),
    "prompt": (("prompt",), ("prompt", "*")),
    "choices": (("choices", "*", "message", "content"), ("choices", "*", "message", "content", "*", "text")),
    "completions": (("choices", "*", "text"),),
}


def _spans(s: str) -> dict[tuple, tuple[int, int]]:
    """(begin, end) of each string value of valid JSON, by its path."""
    out: dict[tuple, tuple[int, int]] = {}

    def value(i: int, path: tuple) -> int:
        i = _SPACE.match(s, i).end()
        c = s[i]
        if c == '"':
            end = scanstring(s, i + 1)[1]
            out[path] = (i, end)
            return end
        if c not in "{[":
            return _OTHER.match(s, i).end()
        k = 0
        i = _SPACE.match(s, i + 1).end()
        while s[i] not in "}]":
            name: object = k
            if c == "{":
                name, i = scanstring(s, i + 1)
                i = _SPACE.match(s, i).end() + 1
                for old in [p for p in out if p[: len(path) + 1] == (*path, name)] if (*path, name) in seen else ():
                    del out[old]
                seen.add((*path, name))
            i = _SPACE.match(s, value(i, (*path, name))).end()
            if s[i] == ",":
                i = _SPACE.match(s, i + 1).end()
            k += 1
        return i + 1

    seen: set[tuple] = set()
    value(0, ())
    return out


def cut(body: str | None, where: str) -> tuple[list[str], list[str], list[str]] | None:
    """(pieces, raws, texts): what lies around the texts, one more than these, and each text as it stands and decoded."""
    try:
        root = json.loads(body) if body is not None else None
        if not isinstance(root, dict):
            return None
        spans = _spans(body)
    except (ValueError, RecursionError):
        return None
    found = []
    for path, (begin, end) in spans.items():
        shape = tuple("*" if isinstance(p, int) else p for p in path)
        if shape not in PATHS[where]:
            continue
        if shape[-2:] == ("*", "text") and shape != ("choices", "*", "text"):
            item = root
            for p in path[:-1]:
                item = item[p]
            if item.get("type") != "text":
                continue
        found.append((begin, end))
    found.sort()
    at, pieces = 0, []
    for begin, end in found:
        pieces.append(body[at:begin])
        at = end
    return [*pieces, body[at:]], [body[b:e] for b, e in found], [scanstring(body, b + 1)[0] for b, _ in found]


def with_changed(rows: DataFrame, body: str, change: Callable[[str], str], where: str = "messages", out: str | None = None) -> DataFrame:
    """``rows`` with the texts of a JSON column changed in place, as column ``out`` (the same, if none is given).

    ``change`` gives SQL for the SQL of a text; a text that it makes null stays. ``where`` is a kind of ``PATHS``.
    """

    @F.pandas_udf(CUT)
    def parts(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in bodies:
            found = [cut(b, where) for b in own]
            yield pd.DataFrame({n: [None if x is None else x[k] for x in found] for k, n in enumerate(("pieces", "raws", "texts"))})

    quoted = lambda t: f"regexp_extract(to_json(array({t})), '(?s)^\\\\[(.*)\\\\]$', 1)"
    put = lambda new: f"if({new} is null or {new} = t, __cut.raws[i], {quoted(new)})"
    texts = f"transform(__cut.texts, (t, i) -> concat({let(change('t'), put)}, __cut.pieces[i + 1]))"
    made = F.expr(f"if(__cut.pieces is null, null, concat(__cut.pieces[0], array_join({texts}, '')))")
    return rows.withColumn("__cut", parts(F.col(body))).withColumn(out or body, made).drop("__cut")
