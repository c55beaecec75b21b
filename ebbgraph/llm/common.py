"""Helpers shared by the corpus operators: stored intermediates, whole-text batches, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ebbgraph.operators.scale import scratch_dir

OUTPUT_ROWS = 512
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, gives Catalyst a true size."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._llm_path = path
    return stored


def drop(*stored: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads."""
    for df in stored:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._llm_path)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no input column has (Spark's names ignore case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Tells texts under one doc_id apart; with the doc_id it identifies a document."""
    return F.xxhash64(text_or_empty(name))


def rowwise(make: Callable[[], Callable], returns: str) -> Callable[[Column], Column]:
    """A function of whole values as a column function, evaluated one Arrow batch at a time.

    ``make`` runs once per task and returns the function of one value. A batch is bounded in bytes
    by ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set) and results go back a few
    hundred rows at a time, so memory does not follow the partition. Cast a string column to binary to get UTF-8 bytes.
    """
    kind = to_arrow_type(T._parse_datatype_string(f"x {returns}")[0].dataType)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            for start in range(0, len(batch), OUTPUT_ROWS):
                yield pa.array([one(x.as_py()) for x in batch.slice(start, OUTPUT_ROWS)], type=kind)

    return run


def keep_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    ``marks`` has a row for each document that needs something done: doc_id, text_key, dropped
    (boolean) and copies (how often the row occurs). Documents without a mark stay. Of a row that
    stays and occurs several times, one copy stays. The join is a merge join at every size, as marks
    grow with the documents; adaptive execution splits a hot key.
    """
    id_, key, gone, copies = (fresh(f"mark_{x}", docs.columns) for x in ("doc", "key", "gone", "copies"))
    renamed = marks.select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("dropped").alias(gone), F.col("copies").alias(copies)
    )
    joined = docs.join(renamed.hint("merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & (text_key() == F.col(key)), "left").where(
        ~F.coalesce(F.col(gone), F.lit(False))
    )
    if marks.where("not dropped and copies > 1").isEmpty():
        return joined.select(*docs.columns)
    several = F.coalesce(F.col(copies), F.lit(1)) > 1
    once = joined.where(several).withColumn(key, text_key()).dropDuplicates(["doc_id", key])
    return joined.where(~several).select(*docs.columns).unionByName(once.select(*docs.columns))
