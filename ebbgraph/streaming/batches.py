"""Micro-batch sinks that carry tables from one batch to the next.

A batch writes only folders named by its batch id and reads those of the batch before,
so a batch that runs again overwrites its own output and nothing is written twice. Give
every sink its own folder, used with one stream checkpoint.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig
from ebbgraph.operators import calibration, decay
from ebbgraph.operators.edges import remove_edges, upsert_edges
from ebbgraph.schema import COLD_EDGE, EDGE
from ebbgraph.sources.config_table import load_decay_config, upsert_lambdas
from ebbgraph.sources.tables import write_cold_edges

ConfigSource = Callable[[SparkSession], DecayConfig]
#: Stores cold records in a folder of its own; returns the edge_ids it could not store, or None.
ColdWriter = Callable[[DataFrame, str], DataFrame | None]


def overwrite_cold(cold: DataFrame, path: str) -> None:
    write_cold_edges(cold, path, mode="overwrite")


#: A pruned edge on its way to other streams; one row without an edge for each pass moves their time on.
PRUNE_EVENT = "edge_id string, src string, dst string, edge_type string, protocol string, src_type string, dst_type string, pruned_at double"


def _publish(df: DataFrame, path: str, name: str) -> None:
    """Write a folder under a hidden name and rename it, so that a stream sees all of its files or none."""
    spark = df.sparkSession
    hidden, shown = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}{name}") for prefix in ("_", ""))
    df.write.mode("overwrite").parquet(f"{path}/_{name}")
    system = hidden.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(shown, True)
    system.rename(hidden, shown)


def _drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class PruneSink:
    """Upsert a batch into the live graph, prune it, keep cold records and a pass reading.

    Under ``path``: live/v=N (snapshot after pass N with its prune flags), cold (by batch
    and day), prunes (the pruned edges again, for streams: see ``prune_stream``), passes (one
    reading per pass, written last: it publishes the snapshot).
    Snapshots older than ``keep`` passes are removed. ``arrival`` names a column of the batch
    that orders writes of one edge; without it their order in the batch counts. Edges that ``writer``
    could not store (all of them if it raises) stay live for the next pass and are counted.
    """

    path: str
    policy: decay.PrunePolicy
    config: ConfigSource = lambda spark: DecayConfig()
    after_pass: Callable[[DataFrame, float, int], None] | None = None
    keep: int = 3
    arrival: str | None = None
    writer: ColdWriter = overwrite_cold

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = self.arrival or F.monotonically_increasing_id()  # of the writes of one edge the last one counts
        writes = batch.select(*EDGE.fieldNames(), (F.col(place) if isinstance(place, str) else place).alias("_arrival"))
        edges = upsert_edges(writes, "_arrival").drop("_arrival")
        if batch_id > 0:  # only ids move: the live graph is not shuffled for a small batch
            edges = remove_edges(self.live(spark, batch_id - 1), edges).unionByName(edges)
        now = batch.agg(F.max("t_e")).first()[0]
        if now is None:
            if batch_id == 0:
                now = float("-inf")
            else:
                now = spark.read.parquet(f"{self.path}/passes/batch={batch_id - 1}").first()["t"]
        marked = decay.mark_prunable(edges, now, self.policy, self.config(spark))
        snapshot = f"{self.path}/live/v={batch_id}"
        marked.write.mode("overwrite").partitionBy("prune").parquet(snapshot)
        written = spark.read.schema(marked.schema).parquet(snapshot)
        cold = decay.cold_records(written, now)
        try:
            failed = self.writer(cold, f"{self.path}/cold/batch={batch_id}")
        except Exception:
            logging.getLogger(__name__).exception("cold records of pass %s were not stored; their edges stay live", batch_id)
            failed = cold
        kept = f"{self.path}/failed/v={batch_id}"
        (spark.createDataFrame([], "edge_id string") if failed is None else failed.select("edge_id").distinct()).write.mode(
            "overwrite"
        ).parquet(kept)
        failures = F.lit(spark.read.parquet(kept).count())
        reading = decay.prune_stats(written).withColumns(
            {"t": F.lit(float(now)), "pruned": F.col("pruned") - failures, "write_failures": failures}
        )
        due = written.filter("prune").join(spark.read.parquet(kept), "edge_id", "left_anti").withColumn("pruned_at", F.lit(float(now)))
        tick = spark.createDataFrame([(None,) * 7 + (float(now),)], PRUNE_EVENT)
        if math.isfinite(now):
            _publish(due.select(*tick.columns).unionByName(tick), f"{self.path}/prunes", f"pass-{batch_id}")
        reading.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/passes/batch={batch_id}")
        if self.after_pass is not None:
            self.after_pass(self.live(spark, batch_id), now, batch_id)
        if batch_id >= self.keep:
            for old in ("live", "failed"):
                _drop_folder(spark, f"{self.path}/{old}/v={batch_id - self.keep}")

    def live(self, spark: SparkSession, version: int) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/live/v={version}")
        gone = F.col("prune").cast("boolean")
        stays, due = rows.filter(~gone), rows.filter(gone)
        failed = spark.read.schema("edge_id string").parquet(f"{self.path}/failed/v={version}")
        return stays.unionByName(due.join(failed, "edge_id", "left_semi")).select(*EDGE.fieldNames())

    def cold(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cold").select(*COLD_EDGE.fieldNames())

    def passes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/passes")

    def prune_stream(self, spark: SparkSession) -> DataFrame:
        """The pruned edges as a stream, with a row that has only ``pruned_at`` for each pass."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/prunes")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return spark.readStream.schema(PRUNE_EVENT).parquet(f"{self.path}/prunes/pass-*")


@dataclass
class RecalibrationSink:
    """Follow inter-arrival gaps batch by batch and move decay rates at every tick.

    Under ``path``: seen/v=N (last time per entity and protocol), recent/v=N (newest gaps
    per protocol, at most a window each), counts/v=N (totals), events/batch=N (rate
    changes), rates (config table that other streams may read).
    """

    path: str
    base: DecayConfig = field(default_factory=DecayConfig)
    min_samples: int = calibration.MIN_SAMPLES
    window_gaps: int = calibration.WINDOW_GAPS
    tick_edges: int = calibration.TICK_EDGES
    max_relative_change: float = calibration.MAX_RELATIVE_CHANGE
    keep: int = 3

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = ("fresh", "t_e", "edge_id")
        rows = batch.select("src", "protocol", "t_e", "edge_id", F.lit(1).alias("fresh"))
        recent, before, arrivals = None, None, 0
        config = self.base
        if batch_id > 0:
            last = batch_id - 1
            rows = rows.unionByName(spark.read.parquet(f"{self.path}/seen/v={last}"))
            recent = spark.read.parquet(f"{self.path}/recent/v={last}")
            counts = spark.read.parquet(f"{self.path}/counts/v={last}")
            before = counts.filter(F.col("protocol").isNotNull()).select("protocol", "gaps")
            arrivals = counts.filter(F.col("protocol").isNull()).first()["arrivals"]
            config = load_decay_config(spark, f"{self.path}/rates", self.base, before=batch_id)

        gaps = calibration.edge_gaps(rows, order)
        fresh = gaps.filter(F.col("fresh") == 1)
        arrived = calibration.dense_index(fresh, ["t_e", "edge_id"], "arrival")
        arrived = arrived.withColumn("arrival", F.col("arrival") + F.lit(arrivals)).persist()
        try:
            numbered = calibration.number_gaps(arrived, before)
            medians = calibration.tick_medians(
                arrived, numbered, recent=recent, gaps_before=before, min_samples=self.min_samples,
                window_gaps=self.window_gaps, tick_edges=self.tick_edges,
            )
            changes = calibration.recalibrate(medians, config, self.max_relative_change)
            changes.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")
            written = spark.read.schema(calibration.RECALIBRATION).parquet(f"{self.path}/events/batch={batch_id}")
            config = calibration.apply_recalibration(config, written)
            upsert_lambdas(spark, f"{self.path}/rates", config.rates, batch_id)

            newest = rows.groupBy("src", "protocol").agg(
                F.max_by(F.struct("t_e", "edge_id"), F.struct(*order)).alias("r")
            )
            newest.select("src", "protocol", "r.t_e", "r.edge_id", F.lit(0).alias("fresh")).write.mode(
                "overwrite"
            ).parquet(f"{self.path}/seen/v={batch_id}")

            totals = numbered.groupBy("protocol").agg(F.count("*").alias("gaps"))
            kept = numbered.select("protocol", "number", "gap")
            if recent is not None:
                kept = kept.unionByName(recent)
                totals = totals.unionByName(before).groupBy("protocol").agg(F.sum("gaps").alias("gaps"))
            arrived_now = spark.createDataFrame([(None, None, arrivals + arrived.count())], "protocol string, gaps long, arrivals long")
            after = f"{self.path}/counts/v={batch_id}"
            totals.withColumn("arrivals", F.lit(None).cast("long")).unionByName(arrived_now).write.mode("overwrite").parquet(after)
            floors = spark.read.parquet(after).select("protocol", (F.col("gaps") - self.window_gaps).alias("_floor"))
            kept.join(floors, "protocol").filter(F.col("number") > F.col("_floor")).drop("_floor").write.mode("overwrite").parquet(
                f"{self.path}/recent/v={batch_id}"
            )
            for old in ("seen", "recent", "counts"):
                if batch_id >= self.keep:
                    _drop_folder(spark, f"{self.path}/{old}/v={batch_id - self.keep}")
        finally:
            arrived.unpersist()

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/events").select(*calibration.RECALIBRATION.fieldNames())
