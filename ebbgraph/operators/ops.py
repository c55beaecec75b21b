"""Operations: audit records, rates, snapshots and analyst feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.functions.columns import priority_score
from ebbgraph.operators.scale import prefix_sums

RATE_WINDOW = 60.0
HISTORY = 1000


#: The fields of audit records; a record has those of its type.
AUDIT = (
    "type string, edge_id string, src string, dst string, edge_type string, protocol string, w_at_prune double, pruned_at double, "
    "motif_name string, chain_key string, triggering_edge_id string, matched_edges array<string>, reset_at double, logged_at double"
)


def prune_audit(cold: DataFrame) -> DataFrame:
    return cold.select(
        F.lit("prune").alias("type"), "edge_id", "src", "dst", "edge_type", "protocol", "w_at_prune", "pruned_at"
    )


def reset_audit(resets: DataFrame) -> DataFrame:
    return resets.select(
        F.lit("motif_reset").alias("type"), "motif_name", "chain_key", "triggering_edge_id", "matched_edges", "reset_at"
    )


def audit_records(cold: DataFrame, resets: DataFrame) -> DataFrame:
    """Both record shapes in one frame; fields of the other shape are null."""
    return prune_audit(cold).unionByName(reset_audit(resets), allowMissingColumns=True)


def audit_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("records"))


# --- rates -------------------------------------------------------------------------


def rate_at(events: DataFrame, t: str, now: float, window: float = RATE_WINDOW) -> DataFrame:
    """Events per second with t >= now - window (there is no upper bound on t)."""
    recent = F.count_if(F.col(t) >= F.lit(float(now) - float(window)))
    return events.agg(_per_second(recent, window).alias("rate"))


def _per_second(count: Column, window: float) -> Column:
    return count / F.lit(float(window)) if window else F.lit(0.0)


def rolling_rate(
    events: DataFrame, t: str, window: float = RATE_WINDOW, *, split: bool = True
) -> DataFrame:
    """(t, rate) at every distinct event time over [t - window, t].

    A sweep: an event enters at t and leaves after t + window, so the count at t is a
    running total of entries minus exits and needs no frame of rows.
    """
    entering = F.struct(F.col(t).alias("at"), F.lit(1).alias("enters"), F.lit(0).alias("leaves"))
    leaving = F.struct((F.col(t) + F.lit(float(window))).alias("at"), F.lit(0).alias("enters"), F.lit(1).alias("leaves"))
    steps = (
        events.select(F.explode(F.array(entering, leaving)).alias("s"))
        .groupBy("s.at").agg(F.sum("s.enters").alias("enters"), F.sum("s.leaves").alias("leaves"))
    )
    totals = prefix_sums(
        steps, [], ["at"], {"entered": F.col("enters"), "left": F.col("leaves")}, split=split
    )
    inside = F.col("entered") - (F.col("left") - F.col("leaves"))
    return totals.filter(F.col("enters") > 0).select(
        F.col("at").alias("t"), _per_second(inside, window).alias("rate")
    )


def last_readings(readings: DataFrame, n: int = HISTORY) -> DataFrame:
    return readings.orderBy(F.desc("t")).limit(n)


def metrics_snapshot(
    now: float, edges: DataFrame, cold: DataFrame, completions: DataFrame, resets: DataFrame,
    prune_readings: DataFrame | None = None, latency_readings: DataFrame | None = None,
    window: float = RATE_WINDOW,
) -> DataFrame:
    """One row: graph size, prune / hit / reset rates, newest epsilon and newest latency."""

    def newest(readings: DataFrame | None, value: str) -> Column:
        if readings is None:
            return F.lit(None).cast("double")
        return readings.agg(F.max_by(value, "t").alias(value)).scalar()

    return edges.agg(F.count("*").alias("active_graph_size")).select(
        "active_graph_size",
        rate_at(cold, "pruned_at", now, window).scalar().alias("prune_rate_per_second"),
        newest(prune_readings, "epsilon").alias("epsilon"),
        rate_at(completions, "completed_at", now, window).scalar().alias("motif_hit_rate_per_second"),
        rate_at(resets, "reset_at", now, window).scalar().alias("motif_reset_rate_per_second"),
        newest(latency_readings, "latency_seconds").alias("latest_inference_latency_seconds"),
    )


# --- feedback ------------------------------------------------------------------------

DISPOSITIONS = ("true_positive", "false_positive")


def motif_priority(feedback: DataFrame) -> DataFrame:
    """Counts and smoothed true-positive rate per motif; an unknown disposition is an error."""
    known = F.col("disposition").isin(*DISPOSITIONS)
    complaint = F.raise_error(F.concat(F.lit("unknown disposition "), F.coalesce("disposition", F.lit("null"))))
    checked = feedback.withColumn("_d", F.when(known, F.col("disposition")).otherwise(complaint.cast("string")))
    counted = checked.groupBy("motif_name").agg(
        F.count_if(F.col("_d") == "true_positive").alias("true_positives"),
        F.count_if(F.col("_d") == "false_positive").alias("false_positives"),
    )
    return counted.withColumn("priority_score", priority_score(F.col("true_positives"), F.col("false_positives")))


def ranked_motifs(feedback: DataFrame) -> DataFrame:
    return motif_priority(feedback).orderBy(F.desc("priority_score"), "motif_name")


def priority_of(feedback: DataFrame, motif_name: str) -> DataFrame:
    """Stats of one motif; without feedback its score is a neutral 0.5."""
    mine = feedback.filter(F.col("motif_name") == motif_name).agg(
        F.count_if(F.col("disposition") == "true_positive").alias("true_positives"),
        F.count_if(F.col("disposition") == "false_positive").alias("false_positives"),
    )
    return mine.select(
        F.lit(motif_name).alias("motif_name"), "*",
        priority_score(F.col("true_positives"), F.col("false_positives")).alias("priority_score"),
    )
