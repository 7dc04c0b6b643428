"""Chat formatting: a state machine over roles checks the order of turns, a template gives the text segments.

A template is data: the strings around a turn, the roles that bear loss, and
the machine's transitions. Control strings inside texts are escaped by one
backslash in each ``<|``; runs of backslashes make this reversible.
"""

from __future__ import annotations

import dataclasses
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Template:
    """``moves``: for the state ``start`` and each role seen last, the roles that may follow. States are named by the last role."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("start", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))


def escaped(text: Column) -> Column:
    """No ``<|`` is left, so no control string is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: ``conv_id``, ``place`` (from 0), ``move_ok``, ``segments`` (array of text and loss flag, in order).

    Turns are ordered by turn, role and text, nulls first; repeated rows are
    turns of their own. A null role or text counts as empty; an empty or
    unknown role is no move of the machine. A turn out of order is formatted
    like any other and has ``move_ok`` false, so the caller decides. Rows with
    a null ``conv_id`` are one conversation. Other columns are ignored. An
    empty table gives no row. Rows are never gathered: a long conversation is
    sorted, with spill, not held.
    """
    moves = F.create_map(*chain.from_iterable((F.lit(s), F.array(*map(F.lit, to))) for s, to in template.moves))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.coalesce(F.lag("role").over(in_order), F.lit("start"))
    seen = turns.withColumns({"place": F.row_number().over(in_order) - 1, "state": state})
    allowed = F.coalesce(F.array_contains(F.try_element_at(moves, F.col("state")), F.col("role")), F.lit(False))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    none = F.lit(False)
    return seen.select("conv_id", "place", allowed.alias("move_ok"), F.array(
        segment(F.concat(F.lit(template.opening), escaped(F.col("role")), F.lit(template.after_role)), none),
        segment(escaped(F.col("text")), F.col("role").isin(*template.loss_roles)),
        segment(F.lit(template.closing), none)).alias("segments"))


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Role and text of each turn back from the segments, with the text under the loss mask and the length of all segments."""
    head, body = F.col("segments")[0]["text"], F.col("segments")[1]
    role = F.substring(head, F.lit(len(template.opening) + 1), F.length(head) - len(template.opening) - len(template.after_role))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return formatted.select("conv_id", "place", "move_ok", unescaped(role).alias("role"), unescaped(body["text"]).alias("text"),
                            unescaped(masked).alias("loss_text"),
                            F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("chars"))
