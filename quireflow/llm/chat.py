"""Chat formatting in DataFrame operations only: a role machine, a template, a loss mask.

A template declares for each role the strings around a turn and whether its text is learnt. Every
control string of the template that occurs inside a text gets a backslash after its first
character, and backslashes are doubled first, so formatted text can be read back exactly.

Rows of a conversation are ordered by turn (null first), then role and text. A first
aggregation formats blocks of `block` consecutive turn numbers, a second one joins the blocks, so
a long conversation reaches the last step as a few ready strings rather than as its rows.

Defined results: a null text is empty, a null role is the role ''; roles that the template does
not know are kept under a marker of their own; invalid turn order is reported in `valid`, never
dropped; repeated rows count as turns; rows with a null id form one conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turns: role -> (before, after, learnt); other: (before role, between, after)."""

    turns: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    accept: tuple[str, ...] = ()

    @property
    def controls(self) -> list[str]:
        marks = [m.strip() for before, after, _ in self.turns.values() for m in (before, after)]
        return sorted({*marks, *(m.strip() for m in self.other)} - {""})


INSTRUCT = Template(
    turns={"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)},
    other=("[ROLE] ", " [:] ", " [/ROLE]"),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    accept=("assistant",),
)


def _java(s: str) -> str:
    return re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", s)


def escape(text: Column, template: Template) -> Column:
    tails = "|".join(_java(c[1:]) for c in template.controls)
    heads = "".join(sorted({_java(c[0]) for c in template.controls}))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"([{heads}])(?={tails})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column, template: Template) -> Column:
    """One formatted turn as segments of (text, loss)."""

    def segments(before: Column, body: Column, after: Column, loss: bool) -> Column:
        part = lambda c, flag: F.struct(c.alias("text"), F.lit(flag).alias("loss"))
        return F.array(part(before, False), part(body, loss), part(after, False))

    body = escape(text, template)
    head = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    out = segments(head, body, F.lit(template.other[2]), False)
    for name, (before, after, loss) in template.turns.items():
        out = F.when(role == name, segments(F.lit(before), body, F.lit(after), loss)).otherwise(out)
    return out


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = INSTRUCT, block: int = 256) -> DataFrame:
    """One row a conversation: conv, n_rows, valid, segments (text, loss), formatted."""
    clean = rows.select(
        F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_x")
    )
    blocks = (
        clean.groupBy("_c", F.floor(F.col("_t") / block).alias("_b"))
        .agg(F.sort_array(F.collect_list(F.struct("_t", "_r", "_x"))).alias("rows"))
        .select("_c", F.struct("_b", F.transform("rows", lambda x: x["_r"]).alias("roles"), F.flatten(F.transform("rows", lambda x: _turn(x["_r"], x["_x"], template))).alias("segments")).alias("block"))
    )
    whole = blocks.groupBy("_c").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    moves = F.create_map(*[F.lit(x) for (state, r), to in template.moves.items() for x in (f"{state}\n{r}", to)])
    roles = F.flatten(F.col("blocks.roles"))
    end = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("reject")))
    out = whole.select(F.col("_c").alias(conv), F.size(roles).alias("n_rows"), end.isin(*template.accept).alias("valid"), F.flatten(F.col("blocks.segments")).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_chats(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), unescaped."""
    kinds = [f"{_java(b)}.*?{_java(a)}" for b, a, _ in template.turns.values()]
    kinds.append(f"{_java(template.other[0])}.*?{_java(template.other[1])}.*?{_java(template.other[2])}")
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(kinds)), F.lit(0))

    def inside(x: Column, before: str, after: str) -> Column:
        return F.substring(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))

    def turn(x: Column) -> Column:
        a, between, z = template.other
        body = inside(x, a, z)
        at = F.locate(between, body)
        rest = F.substring(body, at + len(between), F.length(body))
        out = F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(rest).alias("text"), F.lit(False).alias("loss"))
        for name, (before, after, loss) in template.turns.items():
            own = F.struct(F.lit(name).alias("role"), unescape(inside(x, before, after)).alias("text"), F.lit(loss).alias("loss"))
            out = F.when(F.startswith(x, F.lit(before)), own).otherwise(out)
        return out

    return F.transform(found, turn)


def digests(chats: DataFrame, conv: str = "conv_id", template: Template = INSTRUCT) -> DataFrame:
    """What can be read back from the formatted strings, per conversation."""
    turns = chats.select(conv, "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_chats(F.col("formatted"), template).alias("turns"))
    learnt = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars"
    )
