"""Rate detectors against labelled events.

A detection matches a label of the same key within a time tolerance. Only existence
matters, so no pairs are formed: detections and labels are sorted together per key and
each row looks at the nearest row of the other kind on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbgraph.functions.columns import safe_ratio
from ebbgraph.operators.baseline import Z_THRESHOLD, flag_anomalies
from ebbgraph.operators.scale import HOT_ROWS, materialize, segment_hot

ANOMALY_TOLERANCE = 3600.0
MOTIF_TOLERANCE = 14400.0

LABEL_KEY = ["t", "user", "source_computer", "destination_computer"]


def _near_other_kind(rows: DataFrame, tolerance: float, hot_rows: int | None) -> DataFrame:
    """Add ``hit``: the other kind occurs on the same key within the tolerance.

    Rows have key, t, is_label; t need not be unique (an equal time is a distance of 0
    on whichever side it sorts).
    """
    keys, order = ["key"], ["t", "is_label"]
    cold, hot = segment_hot(rows, keys, order, hot_rows)
    label_t = F.when(F.col("is_label"), F.col("t"))
    event_t = F.when(~F.col("is_label"), F.col("t"))

    def look(df: DataFrame, groups: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*groups).orderBy(*order)
        back = ordered.rowsBetween(Window.unboundedPreceding, 0)
        # looking ahead in time is looking back in the reversed order
        ahead = Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order]).rowsBetween(
            Window.unboundedPreceding, 0
        )
        return df.withColumns(
            {
                "_label_before": F.max(label_t).over(back), "_event_before": F.max(event_t).over(back),
                "_label_after": F.min(label_t).over(ahead), "_event_after": F.min(event_t).over(ahead),
            }
        )

    found = look(cold, keys)
    if hot is not None:
        by_seg = Window.partitionBy(*keys).orderBy("_seg")
        earlier = by_seg.rowsBetween(Window.unboundedPreceding, -1)
        later = by_seg.rowsBetween(1, Window.unboundedFollowing)
        ends = hot.groupBy(*keys, "_seg").agg(
            F.max(label_t).alias("_lmax"), F.min(label_t).alias("_lmin"),
            F.max(event_t).alias("_emax"), F.min(event_t).alias("_emin"),
        )
        carried = ends.select(
            *keys, "_seg",
            F.max("_lmax").over(earlier).alias("_lb"), F.min("_lmin").over(later).alias("_la"),
            F.max("_emax").over(earlier).alias("_eb"), F.min("_emin").over(later).alias("_ea"),
        )
        stitched = look(hot, [*keys, "_seg"]).join(F.broadcast(carried), [*keys, "_seg"])  # one row per segment
        stitched = stitched.withColumns(
            {
                "_label_before": F.coalesce("_label_before", "_lb"), "_label_after": F.coalesce("_label_after", "_la"),
                "_event_before": F.coalesce("_event_before", "_eb"), "_event_after": F.coalesce("_event_after", "_ea"),
            }
        )
        found = found.unionByName(stitched.select(*found.columns))

    def close(column: str):
        return F.coalesce(F.abs(F.col(column) - F.col("t")) <= F.lit(float(tolerance)), F.lit(False))

    return found.withColumn(
        "hit",
        F.when(F.col("is_label"), close("_event_before") | close("_event_after"))
        .otherwise(close("_label_before") | close("_label_after")),
    ).select(*rows.columns, "hit")


def _distinct_labels(labels: DataFrame) -> DataFrame:
    """Equal labels collapsed with their multiplicity; each still counts."""
    return labels.groupBy(*LABEL_KEY).agg(F.count("*").alias("copies"))


def _match(
    events: DataFrame, label_keys: DataFrame, tolerance: float, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """(events with hit, labels with hit). ``events`` has key, t and payload struct ``event``."""
    no_label = F.lit(None).cast(label_keys.select(F.struct(*LABEL_KEY, "copies").alias("x")).schema["x"].dataType)
    both = events.select(
        "key", "t", F.lit(False).alias("is_label"), "event", no_label.alias("label")
    ).unionByName(
        label_keys.select(
            "key", "t", F.lit(True).alias("is_label"),
            F.lit(None).cast(events.schema["event"].dataType).alias("event"),
            F.struct(*LABEL_KEY, "copies").alias("label"),
        )
    )
    # stored: detections are few beside the rows they were found in, and are read several times
    near = _near_other_kind(materialize(both), tolerance, hot_rows)
    rated_events = near.filter(~F.col("is_label")).select("event.*", "hit")
    rated_labels = (
        near.filter("is_label").select("label.*", "hit")
        .groupBy(*LABEL_KEY, "copies").agg(F.bool_or("hit").alias("hit"))
    )
    return rated_events, rated_labels


def match_anomalies(
    signals: DataFrame, labels: DataFrame, z_threshold: float = Z_THRESHOLD,
    tolerance: float = ANOMALY_TOLERANCE, hot_rows: int | None = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(flagged signals with hit, labels with hit), matched by acting user."""
    flagged = flag_anomalies(signals, z_threshold)
    events = flagged.select(
        F.col("entity").alias("key"), "t", F.struct(*flagged.columns).alias("event")
    )
    keyed = _distinct_labels(labels).withColumn("key", F.concat(F.lit("User:"), F.col("user")))
    return _match(events, keyed, tolerance, hot_rows)


def match_motif_alerts(
    completions: DataFrame, labels: DataFrame, tolerance: float = MOTIF_TOLERANCE,
    hot_rows: int | None = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(completions with hit, labels with hit), matched by either computer or the user."""
    events = completions.select(
        F.col("chain_key").alias("key"), F.col("completed_at").alias("t"),
        F.struct(*completions.columns).alias("event"),
    )
    candidates = F.array_compact(
        F.array(
            F.concat(F.lit("Machine:"), F.col("source_computer")),
            F.concat(F.lit("Machine:"), F.col("destination_computer")),
            F.concat(F.lit("User:"), F.col("user")),
        )
    )
    keyed = _distinct_labels(labels).withColumn("key", F.explode(F.array_distinct(candidates)))
    return _match(events, keyed, tolerance, hot_rows)


def false_positives(rated_events: DataFrame) -> DataFrame:
    return rated_events.filter(~F.col("hit")).drop("hit")


def false_negatives(rated_labels: DataFrame) -> DataFrame:
    """Missed labels, one row per copy."""
    missed = rated_labels.filter(~F.col("hit"))
    return missed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*LABEL_KEY)


def detection_metrics(rated_events: DataFrame, rated_labels: DataFrame, detector: str) -> DataFrame:
    """True positives count labels, false positives count detections."""
    sides = rated_events.agg(F.count_if(~F.col("hit")).alias("fp")).select(
        F.lit(0).cast("long").alias("tp"), "fp", F.lit(0).cast("long").alias("fn")
    ).unionByName(
        rated_labels.agg(
            F.coalesce(F.sum(F.when(F.col("hit"), F.col("copies"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(~F.col("hit"), F.col("copies"))), F.lit(0)).alias("fn"),
        ).select("tp", F.lit(0).cast("long").alias("fp"), "fn")
    )
    total = sides.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.select(
        F.lit(detector).alias("detector"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def detection_report(
    signals: DataFrame, completions: DataFrame, labels: DataFrame, z_threshold: float = Z_THRESHOLD,
    anomaly_tolerance: float = ANOMALY_TOLERANCE, motif_tolerance: float = MOTIF_TOLERANCE,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per detector: anomaly and motif."""
    anomaly = match_anomalies(signals, labels, z_threshold, anomaly_tolerance, hot_rows)
    motif = match_motif_alerts(completions, labels, motif_tolerance, hot_rows)
    return detection_metrics(*anomaly, "anomaly").unionByName(detection_metrics(*motif, "motif"))
