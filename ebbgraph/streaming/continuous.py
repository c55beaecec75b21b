"""The continuous run: one streaming query per product, each reading the edge source.

The graph query's prunes are a second source of the motif query, which holds rows back until both
sources' time has passed them; so a pass resets the chains that used what it pruned, as if all ran
in one order of time. Alerts are scored, and prunes and resets logged, as their micro-batch ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbgraph.config import DecayConfig, Motif
from ebbgraph.operators import baseline, decay, graph, ops
from ebbgraph.operators.motifs import EVENT, MIN_CONFIDENCE
from ebbgraph.operators.scale import settings
from ebbgraph.sources.config_table import load_decay_config
from ebbgraph.sources.tables import write_audit
from ebbgraph.streaming.batches import PruneSink, RecalibrationSink
from ebbgraph.streaming.keyed import SIGNAL_LAYOUT, STATE_ON_DISK, completions, ordered_motifs, resets, stream_deviation

ALERT_SCORE = "entity_id string, score double, t double, trigger string, motif_name string, chain_key string, alerts long"


@dataclass
class ContinuousRun:
    """Folders of a run and the readers of its products.

    ``lateness`` (seconds): how far edges may come out of order. With ``available_now`` the graph and
    signal queries run to their end before the motif query starts, so that a run over given files has one
    result; else all run side by side.
    """

    path: str
    policy: decay.PrunePolicy = field(default_factory=decay.PrunePolicy)
    motifs: Sequence[Motif] | None = None
    z_threshold: float = baseline.Z_THRESHOLD
    adaptive: bool = False
    available_now: bool = True
    fuzzy: bool = False
    min_confidence: float = MIN_CONFIDENCE
    timeout: str = "none"
    lateness: float = 0.0

    def folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _start(self, frame: DataFrame, name: str, sink: Callable | None = None) -> StreamingQuery:
        writer = frame.writeStream.queryName(f"{name}").option("checkpointLocation", self.folder(f"checkpoints/{name}"))
        if self.available_now:
            writer = writer.trigger(availableNow=True)
        with settings(frame.sparkSession, STATE_ON_DISK):
            if sink is not None:
                return writer.foreachBatch(sink).start()
            return writer.format("parquet").outputMode("append").start(self.folder(name))

    def start(self, spark: SparkSession, edges: Callable[[], DataFrame]) -> list[StreamingQuery]:
        """Start all queries; ``edges`` opens the edge stream (once per query)."""
        sink = self.prune_sink()
        queries = [self._start(stream_deviation(edges()), "signals"), self._start(edges(), "graph", sink)]
        if self.adaptive:
            queries.append(self._start(edges(), "recalibration", RecalibrationSink(self.folder("recalibration"))))
        if self.available_now:  # the motif query reads what these have written by its start
            for query in queries:
                query.awaitTermination()
        events = ordered_motifs(
            edges(), self.motifs, fuzzy=self.fuzzy, min_confidence=self.min_confidence, timeout=self.timeout,
            lateness=self.lateness, pruned=sink.prune_stream(spark),
        )
        queries.append(self._start(events, "motif_events", self._motif_batch))
        return queries

    def _motif_batch(self, events: DataFrame, batch_id: int) -> None:
        """Store a batch's events, log its resets, score the surroundings of its alerts in the newest live graph."""
        spark = events.sparkSession
        stored = self.folder(f"motif_events/batch={batch_id}")
        events.write.mode("overwrite").parquet(stored)
        events = spark.read.schema(EVENT).parquet(stored)
        write_audit(ops.reset_audit(resets(events)), self.folder(f"audit/resets/batch={batch_id}"), mode="overwrite")
        alerts = completions(events)
        scored = self.folder(f"alert_scores/batch={batch_id}")
        newest = self._newest(spark)
        if newest is None or alerts.isEmpty():
            spark.createDataFrame([], ALERT_SCORE).write.mode("overwrite").parquet(scored)
            return
        z = baseline.latest_deviation(self.signals(spark))
        live = self.prune_sink().live(spark, newest)
        graph.score_alert_neighborhoods(alerts, live, z).write.mode("overwrite").parquet(scored)

    def _newest(self, spark: SparkSession) -> int | None:
        """The last pass whose snapshot is complete."""
        if not _exists(spark, self.folder("graph/passes")):
            return None
        return self.prune_sink().passes(spark).agg(F.max("batch")).first()[0]

    def prune_sink(self) -> PruneSink:
        return PruneSink(self.folder("graph"), self.policy, self._config, self._score_pass)

    def _config(self, spark: SparkSession) -> DecayConfig:
        """Rates as last written by the recalibration query, if it runs and has written any."""
        if not self.adaptive or not _exists(spark, self.folder("recalibration/rates")):
            return DecayConfig()
        return load_decay_config(spark, self.folder("recalibration/rates"))

    def _score_pass(self, live: DataFrame, now: float, batch_id: int) -> None:
        """Scheduled scores after each pass, with the deviations seen so far; and the pass's audit records."""
        pruned = live.sparkSession.read.parquet(self.folder(f"graph/cold/batch={batch_id}"))
        write_audit(ops.prune_audit(pruned), self.folder(f"audit/prunes/batch={batch_id}"), mode="overwrite")
        z = baseline.latest_deviation(self.signals(live.sparkSession))
        graph.scheduled_scores(live, z, now).write.mode("overwrite").parquet(self.folder(f"scores/batch={batch_id}"))

    def signals(self, spark: SparkSession) -> DataFrame:
        if not _exists(spark, self.folder("signals/_spark_metadata")):
            return spark.createDataFrame([], SIGNAL_LAYOUT)
        return spark.read.schema(SIGNAL_LAYOUT).parquet(self.folder("signals"))

    def anomalies(self, spark: SparkSession) -> DataFrame:
        return baseline.flag_anomalies(self.signals(spark), self.z_threshold)

    def motif_events(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder("motif_events")).select(*EVENT.fieldNames())

    def alert_scores(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder("alert_scores")).drop("batch")

    def audit(self, spark: SparkSession) -> DataFrame:
        """Prune and reset records, with the time they were logged at."""
        prunes, resets_ = (spark.read.schema(ops.AUDIT).json(self.folder(f"audit/{kind}")).drop("batch") for kind in ("prunes", "resets"))
        return prunes.unionByName(resets_)

    def snapshot(self, spark: SparkSession, now: float, window: float = ops.RATE_WINDOW) -> DataFrame:
        sink = self.prune_sink()
        passes = sink.passes(spark)
        newest = self._newest(spark)
        events = self.motif_events(spark)
        return ops.metrics_snapshot(
            now, sink.live(spark, newest), sink.cold(spark), completions(events), resets(events), passes, window=window
        )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
