"""Chat formatting with DataFrame functions only: a role automaton and a declarative template.

A template names the turn markers, the roles that carry loss, the transitions of the role automaton and
the control strings that a text must not be able to forge. Texts are escaped reversibly: a backslash is
doubled, and a backslash goes in after the first character of every control string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like.

    Control strings start with a character that they don't repeat, so that breaking the first character
    off breaks every occurrence, overlapping ones too.
    """

    turn: str = "<|turn|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")

    def controls(self) -> list[str]:
        found = [self.turn, self.end, *self.foreign]
        if bad := [c for c in found if len(c) < 2 or "\\" in c or c[0] in c[1:]]:
            raise ValueError(f"control strings need a first character of their own and no backslash: {bad}")
        return found


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls():
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _next_state(template: Template, state: Column, role: Column) -> Column:
    out = F.lit("invalid")
    for (before, reads), after in template.transitions.items():
        out = F.when((state == before) & (role == reads), F.lit(after)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template = TEMPLATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per conv_id: segments array<struct<text, loss>>, formatted, n_turns, valid, bad_turn.

    Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one order
    and are all kept. A null text or role counts as empty; a null conv_id is a conversation of its own.
    valid says that the automaton read every role and ended in an accepting state; bad_turn is the index of
    the first turn it refused (null if none). Invalid conversations are formatted all the same. Further
    columns of the input are ignored. An empty table gives an empty result. A conversation becomes one row,
    since its digest and its training example are one string.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    loss = F.col("role").isin(*template.loss_roles)
    row = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            F.concat(F.lit(template.turn), F.replace(escape(role, template), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
            escape(text, template).alias("body"),
            F.coalesce(loss, F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    found = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    end = F.lit(template.end + "\n")
    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(end.alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("bad"))

    def read(seen: Column, t: Column) -> Column:
        after = _next_state(template, seen["state"], t["role"])
        bad = F.when(seen["bad"].isNull() & (after == "invalid"), seen["read"]).otherwise(seen["bad"])
        return F.struct(after.alias("state"), (seen["read"] + 1).alias("read"), bad.alias("bad"))

    return (
        found.withColumn("run", F.aggregate("ts", start, read))
        .withColumn("segments", segments)
        .select(
            "conv_id",
            "segments",
            F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
            F.size("ts").cast("long").alias("n_turns"),
            F.col("run.state").isin(*template.accepting).alias("valid"),
            F.col("run.bad").alias("bad_turn"),
        )
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, parsed from its markers and unescaped."""
    pieces = F.split(formatted, re.escape(template.end).replace("<", "\\x3C").replace(">", "\\x3E") + "\n")
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = len(template.turn)
    pattern = r"(?s)^((?:\\.|[^\\\n])*+)\n(.*)$"  # possessive: a loop, not a recursion for each character

    def parse(piece: Column) -> Column:
        rest = F.substring(piece, head + 1, 1 << 30)
        return F.struct(
            unescape(F.regexp_extract(rest, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(rest, pattern, 2)).alias("text"),
        )

    return F.transform(whole, parse)


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def digest(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The digests of a formatted table, read back from its output."""
    turns = F.transform(read_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    lost = loss_text(F.col("segments"))
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
