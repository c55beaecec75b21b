"""A training-corpus pipeline of five stages over ``documents``, each stage the next one's input.

Defined results: a null text counts as empty in every stage; a very long text is read whole; of rows that are
repeated whole, one copy stays after exact dedup; of equal or linked texts the stage's own rule names the one
that stays, so ties have one result; an empty table gives an empty result with the last stage's columns;
further columns of ``documents``, whatever their names, are handed through by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbgraph.llm import decontaminate, exact_dedup, quality, sentencepiece_codec, simhash
from ebbgraph.llm.common import store, table
from ebbgraph.llm.queries import tokenizer_model


#: Rows of an Arrow batch: documents can be long, and an executor holds several batches on each side of a Python worker.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for junk or toxic go."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarities of 0.8 or more one stays."""
    small_batches(spark)
    return simhash.similar_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and the digest of what they decode to."""
    small_batches(spark)
    return sentencepiece_codec.codec(docs, tokenizer_model())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", drop_bad),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the classifier, nor the linked documents, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
