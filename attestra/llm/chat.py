"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions.

A template gives each role an opening and a closing control string and says whether its texts bear
loss; roles it does not name are written with ``other``, their name inside the opening. Texts are
escaped so that no control string can occur inside one: a backslash is doubled, and a control string
gets a backslash after its first character; removing one backslash in front of any character undoes
both. A conversation becomes a list of segments (text, loss) whose texts, joined, are its format.

The machine starts in state ``start``; ``moves`` lists the roles each state admits, and a turn moves
it to the state of the turn's role. ``valid`` is false where a turn is not admitted or the last
state is not final; such conversations are formatted all the same.

Turns are ordered by turn, ties by role and text, nulls first. A null text or role is an empty one,
repeated rows are repeated turns, a null conv_id is a conversation, an empty table gives an empty
result, other columns are ignored. The text of a conversation is one value, so its turns do meet in
one task; nothing else does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("<|role:", "|>", "<|end|>")
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        found = [s for r in self.roles.values() for s in (r.open, r.close)] + list(self.other)
        return sorted(dict.fromkeys(found), key=lambda s: (-len(s), s))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    controls = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in template.controls)
    return F.regexp_replace(doubled, controls, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, pick, other) -> Column:
    out = other
    for name, r in template.roles.items():
        out = F.when(role == name, pick(name, r)).otherwise(out)
    return out


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, valid) of rows (conv_id, turn, role, text)."""
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role = F.col("role")
    before, name, close = t.other
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        _by_role(role, t, lambda n, r: F.lit(r.open), F.concat(F.lit(before), escape(role, t), F.lit(name))).alias("open"),
        escape(F.col("text"), t).alias("body"),
        _by_role(role, t, lambda n, r: F.lit(r.close), F.lit(close)).alias("close"),
        _by_role(role, t, lambda n, r: F.lit(r.loss), F.lit(False)).alias("loss"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    state = F.lag("role").over(order)
    admitted = F.lit(False)
    for source, targets in t.moves.items():
        at = state.isNull() if source == "start" else state == source
        admitted = F.coalesce(at & role.isin(*targets), F.lit(False)) | admitted
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("admitted", admitted)
    turn = F.struct("place", "role", "open", "body", "close", "loss", "admitted")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    flat = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(x["open"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                F.struct(x["close"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    ended = F.element_at("turns", -1)["role"].isin(*t.final)
    return grouped.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        flat.alias("segments"),
        (F.forall("turns", lambda x: x["admitted"]) & ended).alias("valid"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read from formatted text alone."""
    t = template or Template()
    before, name, close = t.other
    opens = "|".join([_quoted(r.open) for r in t.roles.values()] + [f"{_quoted(before)}.*?{_quoted(name)}"])
    closes = "|".join([_quoted(r.close) for r in t.roles.values()] + [_quoted(close)])
    pattern = F.lit(f"(?s)({opens})(.*?)({closes})")
    inner = f"(?s)^{_quoted(before)}(.*){_quoted(name)}$"

    def role(head: Column) -> Column:
        out = unescape(F.regexp_extract(head, inner, 1))
        for n, r in t.roles.items():
            out = F.when(head == r.open, F.lit(n)).otherwise(out)
        return out

    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)),
        F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda head, body: F.struct(role(head).alias("role"), unescape(body).alias("text")),
    )


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: s["text"]), ""))
