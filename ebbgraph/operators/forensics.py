"""Questions asked of the cold edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.config import Motif, load_motifs
from ebbgraph.operators.scale import materialize
from ebbgraph.schema import COLD_EDGE
from ebbgraph.sources.tables import cold_days, event_day, read_cold_edges


def deduplicate_cold(cold: DataFrame) -> DataFrame:
    """One record per (edge_id, pruned_at), whatever a retried write left behind."""
    return cold.dropDuplicates(["edge_id", "pruned_at"])


def activity(cold: DataFrame, entity: str, start: float, end: float) -> DataFrame:
    """Cold edges touching an entity with start <= t_e <= end; the filter reaches the scan.

    A column ``day`` (see ``tables.read_cold_edges``) limits the folders that are opened.
    """
    if "day" in cold.columns:
        first, last = (event_day(F.lit(float(t))) for t in (start, end))
        cold = cold.filter(F.col("day").between(first, last)).drop("day")
    return cold.filter(
        ((F.col("src") == entity) | (F.col("dst") == entity))
        & F.col("t_e").between(F.lit(float(start)), F.lit(float(end)))
    )


def reconstruct_activity(cold: DataFrame, entity: str, start: float, end: float) -> DataFrame:
    return activity(cold, entity, start, end).orderBy("t_e", "edge_id", "pruned_at")


def reconstruct_many(cold: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a table of (entity, start, end) with one window per entity."""
    touched = cold.withColumn("entity", F.explode(F.array_distinct(F.array("src", "dst"))))
    joined = touched.join(windows, "entity")
    return joined.filter(F.col("t_e").between(F.col("start"), F.col("end")))


def get_edge(cold: DataFrame, edge_id: str) -> DataFrame:
    return cold.filter(F.col("edge_id") == edge_id)


def newest_activity(cold: DataFrame, entity: str, n: int = 50) -> DataFrame:
    """Newest n edges touching an entity, seen from it."""
    touching = cold.filter((F.col("src") == entity) | (F.col("dst") == entity))
    other = F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src"))
    return (
        touching.select(other.alias("other"), "protocol", "edge_type", "t_e", "pruned_at", "edge_id")
        .orderBy(F.desc("t_e"), "edge_id", "pruned_at").limit(n)
    )


def newest_stored(spark: SparkSession, path: str, entity: str, n: int = 50) -> DataFrame:
    """``newest_activity`` of a cold table in its day folders, opened from the newest day backwards.

    Each step opens twice as many days as the one before and stops when n edges are found, so at most
    about twice the days needed are read; within them Bloom filters on both ends skip row groups.
    """
    table, days, step = read_cold_edges(spark, path, by_day=True), cold_days(spark, path), 1
    taken: list[str] = []
    while True:
        taken, days, step = taken + days[:step], days[step:], 2 * step
        found = newest_activity(table.filter(F.col("day").isin([*taken])), entity, n)
        if not days or found.count() == n:
            return found


def prunes_by_protocol(cold: DataFrame, start: float, end: float) -> DataFrame:
    return (
        cold.filter(F.col("pruned_at").between(F.lit(float(start)), F.lit(float(end))))
        .groupBy("protocol").agg(F.count("*").alias("prunes"))
        .orderBy(F.desc("prunes"), "protocol")
    )


def alert_edges(completions: DataFrame, cold: DataFrame, motifs: Sequence[Motif] | None = None) -> DataFrame:
    """Cold records of the edges an alert lists, in list order (edges not pruned have none).

    A chain's edges lie within its motif's window before its completion. So where ``cold`` has its folder
    column ``day`` (see ``tables.read_cold_edges``), only the days that alerts reach back to are opened.
    """
    if "day" in cold.columns:
        completions = materialize(completions)
        reach = max(m.window_seconds for m in (load_motifs() if motifs is None else motifs))
        first, last = completions.agg(F.min("completed_at"), F.max("completed_at")).first()
        if first is None:
            cold = cold.filter("false")
        else:
            cold = cold.filter(F.col("day").between(*(event_day(F.lit(float(t))) for t in (first - reach, last))))
    listed = completions.select(
        "motif_name", "chain_key", "completed_at",
        F.posexplode("matched_edges").alias("position", "edge_id"),
    )
    return listed.join(cold.select(*COLD_EDGE.fieldNames()), "edge_id")
