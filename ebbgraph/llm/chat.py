"""Chat formatting with relational and column operations only.

A conversation becomes one string: ``<turn ROLE>TEXT<next>TEXT</turn>`` for every run of turns of one
role, so adjacent turns of a role are merged into one block and can still be told apart. Inside
roles and texts a backslash, ``<`` and ``>`` are written ``\\b``, ``\\l`` and ``\\g``; no control string
can then occur in them, and undoing the three replacements gives the text back exactly.

Each turn's piece and its place in the string come from one window over its conversation; the pieces
are collected, sorted and joined. Work is linear in a conversation's length. A conversation is one
row of the result, so one that does not fit a row (2 GB) cannot be formatted; nothing is cut off.

Defined results: a null text or role counts as empty; rows are ordered by turn, then role, then text,
nulls first, so ties and repeated rows have a fixed place and each is a turn; a null conv_id is a
conversation of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, OPEN_END, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>"
LOSS_ROLE = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss: array of (start, end), the code points of ``formatted`` that a loss is taken on."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before, after = F.lag("role").over(order), F.lead("role").over(order)
    head = F.when(F.col("before").isNull() | (F.col("before") != F.col("role")), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPEN_END)))
    tail = F.when(F.col("after").isNull() | (F.col("after") != F.col("role")), F.lit(CLOSE)).otherwise(F.lit(NEXT))
    body = F.col("body")
    pieces = (
        rows.withColumns({"before": before, "after": after, "place": F.row_number().over(order)})
        .withColumns({"head": F.coalesce(head, F.lit("")), "body": escape(F.col("text")), "tail": tail})
        .withColumn("size", (F.length("head") + F.length(body) + F.length("tail")).cast("long"))
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("start", F.col("end") - F.length("tail") - F.length(body))
    )
    piece = F.struct("place", "role", "start", (F.col("end") - F.length("tail")).alias("end"), F.concat("head", "body", "tail").alias("piece"))
    sorted_ = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    lost = F.filter("turns", lambda t: t["role"] == loss_role)
    return sorted_.select(
        "conv_id", F.array_join("turns.piece", "").alias("formatted"),
        F.transform(lost, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text): the turns that a formatted string holds, in order."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, OPEN_END, 1)
        role = unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)))
        texts = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(F.split(texts, NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, CLOSE, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    each = F.transform(loss, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return unescape(F.array_join(each, ""))
