"""Conversations as training text, by Spark expressions alone.

Turns are collected as structs and sorted by turn, role and text.  Adjacent
turns of one role become one block: the role's opening mark, the texts with
``NEXT`` between them, and its closing mark.  Blocks follow each other without
anything between.  Marks and texts are parted by single blanks.

Control strings inside texts and role names are escaped: a backslash is doubled,
and one is put after the first character of whatever reads like a mark.  No mark
has a backslash or a blank inside, so escaped text holds none, not even where it
meets a mark, and reading back undoes every step.

The loss mask is the spans of the assistant's texts, in bytes of the formatted
text; marks are not under it.

Results: a null text or role is empty, a null turn comes first.  Repeated rows
are turns of their own.  Rows of a null id are one conversation.  An empty table
gives no rows; other columns are ignored.  One conversation is one value, which
Spark bounds to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.bind import let

# The marks of a role's block, then those of all other roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, SAYS, NEXT = ("[ROLE]", "[/ROLE]"), "[SAYS]", "[NEXT]"
LEARNED = "assistant"
# What a mark has after its first character.
CONTROL = r"\\|[<\[](?=/?s>|</?SYS>>|/?INST\]|/?ROLE\]|SAYS\]|NEXT\])"
# Lengths added up one by one; longer lists by sums of so many.
RUN = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, part: int) -> Column:
    known = [F.when(role == name, F.lit(f"{marks[part]} " if not part else f" {marks[part]}")) for name, marks in MARKS.items()]
    other = F.concat(F.lit(f"{OTHER[0]} "), escape(role), F.lit(f" {SAYS} ")) if not part else F.lit(f" {OTHER[1]}")
    return F.coalesce(*known, other)


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _blocks(turns: Column) -> Column:
    """Sorted turns as ``role, texts`` of adjacent ones of a role."""
    begins = F.filter(_numbers(F.size(turns)), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))

    def block(starts: Column, s: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(starts, i + 1), F.size(turns))
        return F.struct(turns[s]["role"].alias("role"), F.transform(F.slice(turns, s + 1, stop - s), lambda t: t["text"]).alias("texts"))

    return let(begins, lambda starts: F.transform(starts, lambda s, i: block(starts, s, i)))


def _pieces(block: Column) -> Column:
    """A block's opening, its texts with ``NEXT`` between them, and its closing, as ``text, learned``."""

    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("text"), learned.alias("learned"))

    def each(text: Column, i: Column) -> Column:
        return F.array(piece(F.when(i > 0, F.lit(f" {NEXT} ")).otherwise(F.lit("")), F.lit(False)), piece(escape(text), block["role"] == LEARNED))

    opening, closing = (F.array(piece(_by_role(block["role"], part), F.lit(False))) for part in (0, 1))
    return F.concat(opening, F.flatten(F.transform(block["texts"], each)), closing)


def _spans(pieces: Column) -> Column:
    """``begin, length`` of the learned pieces, in a number of steps that is not the square of theirs."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    def begin(lengths: Column, runs: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        return total(F.slice(runs, F.lit(1), run)) + total(F.slice(lengths, run * RUN + 1, i - run * RUN))

    def spans(lengths: Column, runs: Column) -> Column:
        learned = F.filter(_numbers(F.size(pieces)), lambda i: pieces[i]["learned"])
        return F.transform(learned, lambda i: F.struct(begin(lengths, runs, i).alias("begin"), lengths[i].alias("length")))

    sums = lambda lengths: F.transform(_numbers(F.ceil(F.size(lengths) / RUN).cast("int")), lambda r: total(F.slice(lengths, r * RUN + 1, F.lit(RUN))))
    sized = F.transform(pieces, lambda p: F.octet_length(p["text"]).cast("long"))
    return let(sized, lambda lengths: let(sums(lengths), lambda runs: spans(lengths, runs)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: text, and ``begin, length`` of what is learned, in bytes."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    pieces = let(F.sort_array("turns"), lambda turns: F.flatten(F.transform(_blocks(turns), _pieces)))
    made = let(pieces, lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), _spans(p).alias("loss")))
    # One row, one working out: a struct is not taken apart into copies of what made it.
    return said.select("conv_id", F.inline(F.array(made)))


def read_turns(formatted: Column) -> Column:
    """``role, text`` of every turn, out of the formatted text alone."""
    closed = "|".join(rf"(?<= {_quoted(close)})" for _, close in [*MARKS.values(), OTHER])
    named = rf"(?s)^{_quoted(OTHER[0])} (.*?) {_quoted(SAYS)} "

    def opened(block: Column) -> Column:
        """Role as written, and the number of characters before and after the texts."""
        known = [
            F.when(F.startswith(block, F.lit(f"{opening} ")), F.struct(F.lit(name).alias("role"), F.lit(len(opening) + 1).alias("head"), F.lit(len(closing) + 1).alias("tail")))
            for name, (opening, closing) in MARKS.items()
        ]
        head = len(f"{OTHER[0]}  {SAYS} ")
        other = let(F.regexp_extract(block, named, 1), lambda r: F.struct(unescape(r).alias("role"), (F.length(r) + head).alias("head"), F.lit(len(OTHER[1]) + 1).alias("tail")))
        return F.coalesce(*known, other)

    def turns(block: Column, at: Column) -> Column:
        text = F.substring(block, at["head"] + 1, F.length(block) - at["head"] - at["tail"])
        return F.transform(F.split(text, rf" {_quoted(NEXT)} "), lambda t: F.struct(at["role"].alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, closed), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: let(opened(b), lambda at: turns(b, at))))


def _quoted(mark: str) -> str:
    return mark.replace("[", r"\[").replace("]", r"\]")


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, as it was before it was escaped."""

    def cut(raw: Column, s: Column) -> Column:
        return unescape(F.decode(F.substring(raw, (s["begin"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))

    return F.array_join(let(F.encode(formatted, "UTF-8"), lambda raw: F.transform(loss, lambda s: cut(raw, s))), "")
