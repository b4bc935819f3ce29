r"""Chat formatting with Spark expressions only: turns to one training text and back.

A conversation's turn structs are collected and sorted by turn, adjacent turns of one role are merged
under one header, and the pieces are concatenated::

    ### user:
    first text<also/>second text of the same role</turn>
    ### assistant:
    answer</turn>

Inside texts and roles ``\``, ``<`` and ``#`` (and, in roles, ``:`` and line ends) become ``\b``, ``\l``,
``\h``, ``\c``, ``\n``, so no text can hold a control string and the output reads back exactly.  The loss mask is a
list of spans (start, length in characters): the escaped text of each assistant turn, without marks.

Edge cases: null text or role counts as empty; a null turn sorts first, ties go by role and text;
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows.
A conversation is one output string, so it is as large as one record may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALSO, END = "<also/>", "</turn>\n"
LOSS_ROLE = "assistant"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column, role: bool = False) -> Column:
    return _swap(text, ("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *((((":", "\\c"), ("\n", "\\n"))) if role else ()))


def unescape(text: Column, role: bool = False) -> Column:
    return _swap(text, *((((("\\n", "\n")), ("\\c", ":"))) if role else ()), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\"))


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start: long, length: long>> from rows (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        t = F.col("turns")
        opens = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
        closes = (i == F.size(t) - 1) | (F.get(t, i + 1)["role"] != x["role"])
        head = F.when(opens, F.concat(F.lit("### "), escape(x["role"], True), F.lit(":\n"))).otherwise(F.lit(ALSO))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"), (x["role"] == loss_role).alias("loss"))

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct((start + F.length(p["body"]) + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select("conv_id", text.alias("formatted"), F.aggregate("pieces", zero, walk)["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus turns array<struct<role, text>> and loss_text, both read from the formatted text alone."""

    def block(b: Column) -> Column:
        # "### role:\n" + texts parted by ALSO
        role = unescape(F.substring_index(F.substr(b, F.lit(5)), ":\n", 1), True)
        texts = F.split(F.substr(b, F.locate(":\n", b) + 2), ALSO)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(F.col("formatted"), END), lambda b: b != "")
    loss = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block))).withColumn("loss_text", unescape(F.array_join(loss, "")))
