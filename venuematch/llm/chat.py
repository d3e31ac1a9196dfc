"""Chat formatting from a declarative template, with Spark functions only.

A template gives each role an opening and a closing mark and says whether its text is trained on. Texts are
escaped so that no mark can occur in them. A finite-state machine over the roles checks the order of turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class RoleForm:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of at least two characters, none part of another; ``other`` holds roles without a form, named in the text.

    ``steps`` maps (state, role) to the next state; a missing entry is a wrong turn. A conversation is valid if
    the machine ends in one of ``final``.
    """

    roles: dict[str, RoleForm]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    steps: dict[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"
    final: tuple[str, ...] = ()

    @property
    def marks(self) -> list[str]:
        own = [m for form in self.roles.values() for m in (form.opening, form.closing)]
        return sorted({*own, *self.other})

    def __post_init__(self):
        marks = self.marks
        if len(marks) < 2 * len(self.roles) + 3:
            raise ValueError("every mark must be used once")
        for mark in marks:
            if len(mark) < 2 or ESCAPE in mark or any(mark in other for other in marks if other != mark):
                raise ValueError(f"{mark!r} can't be told apart from the other marks")


INSTRUCT = ChatTemplate(
    roles={
        "system": RoleForm("<<SYS>>", "<</SYS>>"),
        "user": RoleForm("[INST]", "[/INST]"),
        "assistant": RoleForm("<s>", "</s>", loss=True),
    },
    steps={
        ("start", "system"): "instructed",
        ("start", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=("answered",),
)


def escaped(text: Column, template: ChatTemplate) -> Column:
    """Doubles the escape sign, then breaks every mark after its first character with a single one."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda x, m: F.replace(x, F.lit(m), F.lit(m[0] + ESCAPE + m[1:])), template.marks, out)


def unescaped(text: Column) -> Column:
    """A doubled escape sign becomes one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _chosen(role: Column, template: ChatTemplate, value, other: Column) -> Column:
    out = reduce(lambda c, r: c.when(role == r, value(template.roles[r])), template.roles, F)
    return out.otherwise(other)


def _segments(turn: Column, template: ChatTemplate) -> Column:
    """Opening, text and closing of one turn, each with its loss flag."""
    begin, middle, end = template.other
    named = F.concat(F.lit(begin), escaped(turn["role"], template), F.lit(middle))

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(
        part(_chosen(turn["role"], template, lambda f: F.lit(f.opening), named), F.lit(False)),
        part(escaped(turn["text"], template), _chosen(turn["role"], template, lambda f: F.lit(f.loss), F.lit(False))),
        part(_chosen(turn["role"], template, lambda f: F.lit(f.closing), F.lit(end)), F.lit(False)),
    )


def _final_state(roles: Column, template: ChatTemplate) -> Column:
    if not template.steps:
        return F.lit(template.start)
    table = F.create_map(*(F.lit(x) for (state, role), to in template.steps.items() for x in (f"{state}>{role}", to)))
    step = lambda state, role: F.coalesce(table[F.concat(state, F.lit(">"), role)], F.lit("wrong"))
    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """(conv_id, valid, segments, formatted), one row per conversation of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by (turn, role, text), nulls first; repeated rows stay. A null text or role is empty; an
    empty or unknown role uses the template's own form for others and makes the order of turns invalid, but the
    conversation is formatted all the same. Rows with a null conv_id form one conversation. ``segments`` holds
    (text, loss) in order, empty ones included, and ``formatted`` is their concatenation. Other columns are not read.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return (
        chats.withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t, template))))
        .withColumn("valid", _final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.final))
        .select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def _between(piece: Column, opening: str, closing: str) -> Column:
    return piece.substr(F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))


def read_chats(formatted: Column, template: ChatTemplate = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    begin, middle, end = template.other
    spans = [(f.opening, f.closing) for f in template.roles.values()] + [(begin, end)]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in spans)
    pieces = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turn(piece: Column) -> Column:
        inner = _between(piece, begin, end)
        role, text = F.substring_index(inner, middle, 1), F.substring_index(inner, middle, -1)
        for name, form in template.roles.items():
            own = piece.startswith(form.opening)
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, _between(piece, form.opening, form.closing)).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescaped(s["text"])), "")
