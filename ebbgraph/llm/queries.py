"""The registered corpus queries: each applies one operator to the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.llm import (
    chat, decontaminate, exact_dedup, html_text, lexical, lines, merkle, parity_join, quality, secrets, sentencepiece_codec, simhash, token_counts,
)
from ebbgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: The public tokenizer's model file; the driver reads it and ships its bytes, so executors need no copy.
TOKENIZER = os.environ.get("EBBGRAPH_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def tokenizer_model(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op1_line_dedup_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op1_line_dedup``, but repeated runs go to their last line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, whole_runs=True).select("doc_id", "n_lines", "n_deleted", "text")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [secrets.count_of_kind(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalised(), 256)
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), {"text_sha256": digest})
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), "contaminated",
    )


#: The conversation that the query adds, of texts that look like control strings.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns.unionByName(added))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("lost"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec(table(spark, sf_dir, "documents"), tokenizer_model())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_model())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The fields of a leaf, in order; of the rows where TAMPERED divides crc32 of the id, the text is changed.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proof digests; a fifth of the rows is folded from a changed text."""
    values = {name: F.col(name) for name in LEAF_FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = F.when(chosen, merkle.leaf(list({**values, "text": lowered}.values())))
    proven = merkle.manifest(table(spark, sf_dir, "documents"), values, "source", "doc_id", {"changed": changed})
    folded = proven.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op1_line_dedup_whole_runs, op2_quality_classifier, op3_html_extraction, op4_secret_scans, op5_exact_dedup, op6_simhash_near_dedup, op7_chat_formatting, op8_sentencepiece_codec,
        op9_benchmark_decontamination, op10_token_counts, op11_ranked_search, op12_merkle_manifest, op13_jaccard_join,
    )
}
