"""Exact deduplication by progressive refinement, in DataFrame operations only.

A first scan gives every text's normalised length and the hash of a short prefix, as rows of a few
bytes. Grouping by length, then by (length, prefix hash), leaves the keys that more than one
document has; only documents under such a key are read again for a hash of their full content.
Counting uses partial aggregation, so a group of copies that holds a third of all rows arrives as
one row per task; the joins are plain equi-joins that adaptive execution splits where a key is hot.

Defined results: a null text counts as empty; a null doc_id is an id of its own and comes before
all others; rows with equal doc_id and equal text are one document (``group_size`` counts each row,
the result has one row for them); an empty table gives an empty result; extra columns are ignored
by ``exact_groups`` and kept by ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import keep_marked, store, text_key, text_or_empty

#: Fixed value: the characters that normalising deletes, ASCII white space.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX_CHARS = 64


def normalised(name: str = "text") -> Column:
    return F.translate(text_or_empty(name), WHITE_SPACE, "")


def exact_groups(docs: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, text_key, keep_id, keep_key, group_size, copies, kept, and the columns of ``carry``.

    Of equal texts the row with the most code points in the original stays, then the smallest doc_id.
    ``carry`` names expressions over ``docs`` to compute in the first scan and hand through.
    """
    carry = dict(carry or {})
    norm = normalised()
    rows = docs.select(
        "doc_id", text_key().alias("text_key"), F.length(text_or_empty()).alias("chars"), F.length(norm).alias("size"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"), *[c.alias(n) for n, c in carry.items()],
    )
    light = store(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))

    by_size = store(light.groupBy("size").count().where("count > 1").select("size"))  # distinct lengths: few, of known size
    by_prefix = (
        light.join(by_size, "size", "left_semi").groupBy("size", "prefix").count().where("count > 1").select("size", "prefix")
    )
    alike = store(by_prefix)

    full = F.sha2(norm, 256)
    again = (
        docs.select(
            "doc_id", text_key().alias("text_key"), F.length(norm).alias("size"),
            F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"), text_or_empty().alias("text"),
        )
        .join(alike, ["size", "prefix"], "left_semi")
        .select("doc_id", "text_key", F.length("text").alias("chars"), full.alias("full"))
    )
    hashed = store(again)
    best = hashed.groupBy("full").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("chars"), "doc_id", "text_key")).alias("best"),
    )
    grouped = (
        hashed.select("doc_id", "text_key", "full").distinct()
        .join(best.where("group_size > 1"), "full")
        .select(
            F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key"), "group_size",
            F.col("best.doc_id").alias("keep_id"), F.col("best.text_key").alias("keep_key"),
        )
    )
    joined = light.join(grouped, light["doc_id"].eqNullSafe(F.col("g_doc")) & (light["text_key"] == F.col("g_key")), "left")
    return joined.select(
        "doc_id", "text_key",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_key", "text_key").alias("keep_key"),
        F.coalesce("group_size", "copies").alias("group_size"), "copies",
        (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")))).alias("kept"),
        *carry,
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of a repeated row, one copy."""
    marks = exact_groups(docs).where("not kept or copies > 1")
    return keep_marked(docs, store(marks.select("doc_id", "text_key", (~F.col("kept")).alias("dropped"), "copies")))
