"""Chat formatting: a state machine over roles checks turn order and emits segments with loss flags.

A template is data: for each role the state it leads to, the marks around its text and whether its text bears loss.
Control strings inside texts are escaped reversibly, so that a formatted conversation can be cut into turns again.

Defined cases: a null text is empty, a null role is the unknown role ""; turns are taken by turn, then role, then text,
so ties and repeated rows have one order; an order that the machine forbids is formatted all the same and reported
in ``violation`` (the first turn that breaks it); conversations are read as a stream, so their length is not bounded
by memory. Rows without conv_id form one conversation. Other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows


@dataclass(frozen=True)
class Role:
    prefix: str
    suffix: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Roles by name; ``after`` names the roles a turn may follow, "" being the start. ``escape`` stands before each
    escaped place, which begins one of ``controls``."""

    roles: dict[str, Role]
    controls: tuple[str, ...]
    escape: str = "\\"
    unknown: Role = field(default_factory=lambda: Role("[ROLE]", "[/ROLE]", False, ()))

    def role(self, name: str) -> Role:
        return self.roles.get(name, self.unknown)


DEFAULT = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>", False, ("",)),
        "user": Role("<s>[INST] ", " [/INST]", False, ("", "system", "assistant")),
        "assistant": Role("<a>", "</s>", True, ("user",)),
    },
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "<a>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NAME]"),
)


def escaped(text: str, template: Template = DEFAULT) -> str:
    """``text`` with the escape character doubled and with one put after the first character of each control string."""
    e = template.escape
    text = text.replace(e, e + e)
    for c in template.controls:
        text = text.replace(c, c[0] + e + c[1:])
    return text


def unescaped(text: str, template: Template = DEFAULT) -> str:
    """The inverse of ``escaped``: a doubled escape is one, a single one goes."""
    e = template.escape
    return e.join(part.replace(e, "") for part in text.split(e + e)) if e in text else text


class Machine:
    """Follows the roles of one conversation; ``violation`` is the number of the first turn out of order."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.violation, self.turns = template, "", None, 0

    def step(self, role: str) -> None:
        if self.violation is None and (role not in self.template.roles or self.state not in self.template.roles[role].after):
            self.violation = self.turns
        self.state, self.turns = role, self.turns + 1


def segments(role: str, text: str, template: Template = DEFAULT) -> list[tuple[str, bool, bool]]:
    """A turn as (text, loss, is a mark); a role that the template does not know is named inside its marks."""
    own = template.role(role)
    name = [] if role in template.roles else [(escaped(role, template), False, False), ("[NAME]", False, True)]
    return [(own.prefix, False, True), *name, (escaped(text, template), own.loss, False), (own.suffix, False, True)]


SEGMENT = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn_no", T.LongType()), T.StructField("segment_no", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("violation", T.LongType())]
)


def format_segments(convs: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The segments of every conversation, in order within its partition: text, loss flag and what broke the order so far."""
    dealt = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, machine = object(), Machine(template)
        for conv, _, role, text in rows:
            if conv != now:
                now, machine = conv, Machine(template)
            turn = machine.turns
            machine.step(role)
            for k, (piece, loss, _mark) in enumerate(segments(role, text, template)):
                yield conv, turn, k, piece, loss, machine.violation

    return map_rows(dealt, ["conv_id", "turn", "role", "text"], make, SEGMENT)


def read_turn(text: str, template: Template = DEFAULT) -> tuple[str, str]:
    """Role and text of one formatted turn, found by its marks."""
    for name, own in template.roles.items():
        if text.startswith(own.prefix) and text.endswith(own.suffix):
            return name, unescaped(text[len(own.prefix) : len(text) - len(own.suffix)], template)
    own = template.unknown
    name, _, rest = text[len(own.prefix) : len(text) - len(own.suffix)].partition("[NAME]")
    return unescaped(name, template), unescaped(rest, template)


DIGEST = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("violation", T.LongType())]
)


def conversation_digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Reads each conversation back from its segments: turns, text under the loss mask and length.

    ``formatted`` must come straight from ``format_segments``, whose order it relies on. State per conversation is two
    running hashes and one turn.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = None
        for conv, turn, piece, loss, violation in rows:
            if state is None or state["conv"] != conv:
                if state is not None:
                    yield _closed(state, template)
                state = {"conv": conv, "turn": turn, "parts": [], "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0, "violation": None}
            elif state["turn"] != turn:
                _end_turn(state, template)
                state["turn"] = turn
            state["parts"].append(piece)
            state["chars"] += len(piece)
            state["violation"] = violation
            if loss:
                own = unescaped(piece, template)
                state["loss"].update(own.encode())
                state["loss_n"] += len(own)
        if state is not None:
            yield _closed(state, template)

    return map_rows(formatted, ["conv_id", "turn_no", "segment", "loss", "violation"], make, DIGEST)


def _end_turn(state: dict, template: Template) -> None:
    role, text = read_turn("".join(state["parts"]), template)
    state["all"].update(f"{role}\n{text}\n".encode())
    state["n"] += 1
    state["parts"] = []


def _closed(state: dict, template: Template) -> tuple:
    _end_turn(state, template)
    return state["conv"], state["n"], state["all"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"], state["violation"]


def with_probe(convs: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold the template's own marks."""
    probe = "</s>[INST] ok [/INST]"
    extra = convs.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return convs.select("conv_id", "turn", "role", "text").unionByName(extra)
