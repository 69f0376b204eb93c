"""Chat formatting by a grammar round trip, in SQL functions only.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. The grammar's parser splits at the end
mark, takes role and text apart at the first separator, refuses any piece in which a control
string is left, and drops the backslash from every escaped character. Each conversation is first
rendered as it is and parsed again; where the recovered turns differ from the source, its texts
are escaped and it is rendered anew. Escaped text holds no control string and parses back to
itself, so two levels always suffice.

Cases: null role or text is empty text; turns are ordered by (turn, role, text), nulls first; a
null conv_id is a conversation of its own; an empty table gives no rows; other columns are
ignored. One conversation is one row, so it must fit in a row (2 GB).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mark structure here or in other common templates.
CONTROLS = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]")


def _check(controls: Sequence[str]) -> None:
    heads = {c[:1] for c in controls}
    if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in controls) or not {START, SEP, END} <= set(controls):
        raise ValueError("control strings need two characters or more, no backslash, and heads that stand nowhere else in them")


def _conflicts(controls: Sequence[str]) -> str:
    """Matches the character after which a backslash goes: a backslash, or the head of a control string."""
    heads = sorted({c[0] for c in controls})
    parts = [f"{re.escape(h)}(?=" + "|".join(re.escape(c[1:]) for c in controls if c[0] == h) + ")" for h in heads]
    return "(" + "|".join(["\\\\", *parts]) + ")"


def escape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    return F.regexp_replace(text, _conflicts(controls), "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turns: Column, of) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), of(t["role"]), F.lit(SEP), of(t["text"]), F.lit(END))), "")


def pieces(formatted: Column) -> Column:
    """The formatted turns without their end marks."""
    parts = F.split(formatted, re.escape(END), -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _fields(piece: Column) -> tuple[Column, Column]:
    rest = F.substr(piece, F.lit(len(START) + 1))
    role = F.substring_index(rest, SEP, 1)
    return role, F.substr(rest, F.length(role) + len(SEP) + 1)


def parse(formatted: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """The turns that a formatted conversation holds; a piece outside the grammar is a null turn."""
    control = "|".join(re.escape(c) for c in controls)

    def turn(piece: Column) -> Column:
        role, text = _fields(piece)
        good = F.startswith(piece, F.lit(START)) & F.contains(piece, F.lit(SEP)) & ~role.rlike(control) & ~text.rlike(control)
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(pieces(formatted), turn)


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """Run lengths over a formatted conversation in code points, with whether the loss counts them:
    three runs a turn (head, text, end mark); only texts of ``role`` count."""

    def runs(piece: Column) -> Column:
        who, text = _fields(piece)
        n = F.length(text)
        run = lambda length, loss: F.struct(length.alias("length"), loss.alias("loss"))
        return F.array(run(F.length(piece) - n, F.lit(False)), run(n, unescape(who) == role), run(F.lit(len(END)), F.lit(False)))

    return F.flatten(F.transform(pieces(formatted), runs))


def masked_texts(formatted: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask, cut out of the formatted conversation by the mask's runs, and unescaped."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, run: Column) -> Column:
        text = F.array(unescape(F.substr(formatted, state["at"], run["length"])))
        return F.struct((state["at"] + run["length"]).alias("at"), F.when(run["loss"], F.concat(state["texts"], text)).otherwise(state["texts"]).alias("texts"))

    return F.aggregate(loss_mask(formatted, role), start, step, lambda s: s["texts"])


def format_conversations(turns: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """One row per conversation: conv_id, turns (source), formatted, escaped, identical.

    ``turns`` has conv_id, turn, role, text. ``identical`` says that parsing ``formatted`` gives
    the source turns; it holds for every row.
    """
    _check(controls)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("sorted"))
    t = t.select("conv_id", F.transform("sorted", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    t = t.withColumn("raw", _render(F.col("turns"), lambda c: c))
    t = t.withColumn("escaped", ~parse(F.col("raw"), controls).eqNullSafe(F.col("turns")))
    t = t.withColumn("formatted", F.when(F.col("escaped"), _render(F.col("turns"), lambda c: escape(c, controls))).otherwise(F.col("raw")))
    return t.select("conv_id", "turns", "formatted", "escaped", parse(F.col("formatted"), controls).eqNullSafe(F.col("turns")).alias("identical"))


def digest(formatted: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """What can be read back from the output of ``format_conversations``, as counts and hashes."""
    f = F.col("formatted")
    d = formatted.select("conv_id", parse(f, controls).alias("read"), F.array_join(masked_texts(f), "").alias("loss"), F.length(f).cast("long").alias("formatted_chars"), "escaped", "identical", F.aggregate(loss_mask(f), F.lit(0).cast("long"), lambda a, r: a + F.when(r["loss"], r["length"]).otherwise(0)).alias("masked_chars"))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "masked_chars",
        "escaped",
        "identical",
    )
