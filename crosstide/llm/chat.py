"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECT = "reject"


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked, which turn may follow which, and what is learned.

    ``moves`` maps (state, role) to the next state; a missing pair is a broken
    turn order.  Control strings all start with ``<|``; inside a text every
    ``<`` + backslashes + ``|`` gets one backslash more, so no text can hold a
    control string and ``unescape`` restores it exactly.
    """

    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "told",
            ("begin", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: line feeds become ``\\n``, then control strings are escaped as in texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, template: ChatTemplate = CHATML, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``key``, ``segments``, ``valid``, ``broken_at``.

    ``segments`` is an array of (text, loss): for each turn its opening with
    the role, its escaped text, its end.  Only texts of ``loss_roles`` carry
    the flag.  Joined, the segments are the formatted conversation.

    Turns are ordered by turn number (NULL first), ties by role, then text;
    repeated rows are turns of their own.  NULL roles and texts are empty
    strings.  ``valid`` says whether the roles end in an accepting state;
    ``broken_at`` is the first position (from 0) whose role has no move, else
    NULL.  Rows with a NULL key form one conversation.  An empty table gives
    no rows.  Other columns are ignored.

    Escaping runs on single turns before the shuffle.  A conversation's text
    is one value by definition, so it must fit one row (2 GB); everything else
    is spread.
    """
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(key).alias("k"), F.struct(F.col(turn).alias("at"), r.alias("role"), x.alias("raw"), escape(x).alias("body"), escape_role(r).alias("head")).alias("t"))
    grouped = rows.groupBy("k").agg(F.array_sort(F.collect_list("t")).alias("t"))
    moves = F.create_map(*[F.lit(v) for (state, name), to in template.moves.items() for v in (f"{state} {name}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def move(s: Column, one: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit(" "), one["role"])), F.lit(REJECT))
        return F.struct(to.alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["broken"], F.when(to == REJECT, s["at"])).alias("broken"))

    def segment(content: Column, loss: Column) -> Column:
        return F.struct(content.alias("text"), loss.alias("loss"))

    def pieces(one: Column) -> Column:
        learned = one["role"].isin(*template.loss_roles) if template.loss_roles else F.lit(False)
        opening = F.concat(F.lit(template.turn_start), one["head"], F.lit("\n"))
        return F.array(segment(opening, F.lit(False)), segment(one["body"], learned), segment(F.lit(template.turn_end), F.lit(False)))

    ended = grouped.select("k", F.flatten(F.transform("t", pieces)).alias("segments"), F.aggregate("t", begin, move).alias("end"))
    return ended.select(F.col("k").alias(key), "segments", F.col("end.state").isin(*template.accepting).alias("valid"), F.col("end.broken").alias("broken_at"))


def conversation_text(segments: str | Column = "segments") -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(segments: str | Column = "segments") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(whole: Column, template: ChatTemplate = CHATML) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    parts = F.split(whole, template.turn_end.replace("|", r"\|"))
    turns = F.filter(parts, lambda p: p != "")

    def parsed(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template.turn_start) + 1), F.length(p))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    return F.transform(turns, parsed)
