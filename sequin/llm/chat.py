"""Operator 5, chat formatting, with DataFrame functions only.

A ``Template`` declares, for each role, the strings around a turn and whether
its text is trained on, and the turn order as a finite-state machine: a
transition table from (state, role) to state, run over the turns of a
conversation by ``aggregate``. A role without a line in the template is written
with its name, so that every conversation can be formatted and read back;
``valid`` tells whether the machine accepts it.

Control strings inside a text are escaped by a backslash after their first
character (``</s>`` becomes ``<\\/s>``), and one more where there are some
already; taking one away reads them back. No control string has ``<`` or ``[``
behind its first character, so none can arise across a boundary.

Edge cases: a null text is an empty turn and a null role an empty role; turns
are ordered by (turn, role, text), nulls first, repeated rows are turns of their
own; the rows of a null conv_id are one conversation. The turns of one
conversation are one row: it is one training example.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)})
    #: Of any other role: open + name + mark + text + close.
    other: Role = Role("[ROLE]", "[/ROLE]")
    mark: str = "[TEXT]"
    #: (state, role) to state; anything else is refused.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        every = [*self.roles.values(), self.other]
        out = [x for r in every for x in (r.open, r.close)] + [self.mark]
        for x in out:
            if x[:1] not in ("<", "[") or any(c in x[1:] for c in "<[\\"):
                raise ValueError(f"a control string starts with < or [ and has neither, nor a backslash, behind: {x!r}")
        return out


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\[]()<>/{}.+*?^$|" and c not in "<>/" else c for c in s)


def _tails(t: Template) -> str:
    return "|".join(dict.fromkeys(_quoted(x[1:]) for x in t.controls()))


def escape(text: Column, t: Template = Template()) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_tails(t)})", r"$1$2\\$3")


def unescape(text: Column, t: Template = Template()) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_tails(t)})", "$1$2$3")


def segments(role: Column, text: Column, t: Template = Template()) -> Column:
    """The segments of one turn: (text, loss) in order."""
    seg = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
    other = F.array(seg(F.concat(F.lit(t.other.open), escape(role, t), F.lit(t.mark)), False), seg(escape(text, t), False), seg(F.lit(t.other.close), False))
    out = None
    for name, r in t.roles.items():
        own = F.array(seg(F.lit(r.open), False), seg(escape(text, t), r.loss), seg(F.lit(r.close), False))
        out = F.when(role == name, own) if out is None else out.when(role == name, own)
    return other if out is None else out.otherwise(other)


def accepted(roles: Column, t: Template = Template()) -> Column:
    """Whether the machine takes the roles, in order, from ``start`` to an accepting state."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("refused"))
    return F.aggregate(roles, F.lit("start"), step).isin(*t.accept)


def format_chat(turns: DataFrame, t: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, valid, segments (text, loss), formatted."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segs = F.flatten(F.transform("turns", lambda x: segments(x["role"], x["text"], t)))
    out = convs.select("conv_id", accepted(F.transform("turns", lambda x: x["role"]), t).alias("valid"), segs.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """The turns (role, text, loss) of a formatted conversation, from the text alone."""
    opens = "|".join(_quoted(r.open) for r in [*t.roles.values(), t.other])
    closes = "|".join(_quoted(r.close) for r in [*t.roles.values(), t.other])
    pattern = F.lit(rf"(?s)({opens})(.*?)(?:{closes})")
    marks, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))

    def turn(pair: Column) -> Column:
        mark, body = pair["mark"], pair["body"]
        parts = lambda role, text, loss: F.struct(role.alias("role"), unescape(text, t).alias("text"), F.lit(loss).alias("loss"))
        own = unescape(F.substring_index(body, t.mark, 1), t)
        rest = F.substring(body, F.instr(body, F.lit(t.mark)) + len(t.mark), F.length(body))
        out = parts(own, rest, False)
        for name, r in t.roles.items():
            out = F.when(mark == r.open, parts(F.lit(name), body, r.loss)).otherwise(out)
        return out

    return F.transform(F.arrays_zip(marks.alias("mark"), bodies.alias("body")), turn)
