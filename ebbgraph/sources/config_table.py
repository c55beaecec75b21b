"""Decay rates kept as an append-only table, read again by every micro-batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig

LAYOUT = "protocol string, lambda_p double, version long"


def upsert_lambdas(spark: SparkSession, path: str, rates: Mapping[str, float], version: int) -> None:
    """Write a version of some rates; writing the same version again replaces it."""
    rows = [(protocol, float(rate)) for protocol, rate in rates.items()]
    frame = spark.createDataFrame(rows, "protocol string, lambda_p double")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={int(version)}")


def load_decay_config(spark: SparkSession, path: str, base: DecayConfig | None = None, before: int | None = None) -> DecayConfig:
    """Newest rate per protocol over the base config (optionally only versions before one)."""
    config = base or DecayConfig()
    rows = spark.read.schema(LAYOUT).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("protocol").agg(F.max_by("lambda_p", "version").alias("lambda_p"))
    for row in newest.collect():
        config = config.with_lambda(row["protocol"], row["lambda_p"])
    return config
