"""Chat formatting with a declarative template, a role machine and per-segment loss flags.

Each conversation becomes one string and the list of its segments (text, loss). The template
names the strings around a turn; texts are escaped so that no control string can occur inside
them, and unescaping gives back every text exactly.

Defined results: null texts and roles count as empty; turns are ordered by turn, then role, then
text (a null turn comes first), repeated rows are kept; a null conversation id is an id of its
own; very long texts and conversations are formatted whole, one conversation being one string and so
one row of one task; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Strings around a turn, the roles whose text is learned from, and the role machine.

    The escapes replace each reserved character by a backslash and a letter of its own, the
    backslash itself first; they are undone in reverse order. Control strings must contain a
    reserved character that ``turn_end`` also starts with.
    """

    open: str = "<turn>### "
    after_role: str = ": "
    turn_end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
    text_escapes: int = 3
    start: str = "start"
    accepting: tuple[str, ...] = ("user", "assistant")
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


def escape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, safe in pairs:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def _machine(t: ChatTemplate) -> Column:
    """State transitions as one map from 'state>role' to the next state."""
    return F.create_map(*[F.lit(x) for state, roles in t.transitions.items() for r in roles for x in (f"{state}>{r}", r)])


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv id, valid (the turn order is accepted), segments array<struct<text,loss>>, formatted."""
    t = template or ChatTemplate()
    d = rows.select(
        F.col(conv_col).alias(conv_col),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_t"),
    )
    g = d.groupBy(conv_col).agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    trans = _machine(t)
    step = lambda s, x: F.coalesce(F.element_at(trans, F.concat(s, F.lit(">"), x["role"])), F.lit("rejected"))
    final = F.aggregate("_turns", F.lit(t.start), step)

    def parts(x: Column) -> Column:
        head = F.concat(F.lit(t.open), escape(x["role"], t.escapes), F.lit(t.after_role))
        body = escape(x["text"], t.escapes[: t.text_escapes])
        flag = x["role"].isin(*t.loss_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(body.alias("text"), flag.alias("loss")),
            F.struct(F.lit(t.turn_end).alias("text"), F.lit(False).alias("loss")),
        )

    g = g.select(conv_col, final.isin(*t.accepting).alias("valid"), F.flatten(F.transform("_turns", parts)).alias("segments"))
    return g.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns array<struct<role,text>> of a formatted string."""
    t = template or ChatTemplate()
    stop = t.turn_end[0]
    pattern = "".join(["\\Q", t.open, "\\E([^", t.after_role[0], stop, "]*)\\Q", t.after_role, "\\E([^", stop, "]*)\\Q", t.turn_end, "\\E"])
    role, text = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)), F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(role.alias("role"), text.alias("text")),
        lambda x: F.struct(unescape(x["role"], t.escapes).alias("role"), unescape(x["text"], t.escapes[: t.text_escapes]).alias("text")),
    )


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t.escapes[: t.text_escapes])), "")


def digest_chats(formatted: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what can be read back from the output of format_chats."""
    d = formatted.select(conv_col, "valid", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
