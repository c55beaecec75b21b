"""Whole-run compositions of the operators: evaluate detectors, score entities, prune along a replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig, Motif
from ebbgraph.operators import baseline, decay, evaluation, graph, motifs as M
from ebbgraph.operators.scale import HOT_ROWS, materialize


def evaluate_detectors(
    edges: DataFrame, labels: DataFrame, motifs: Sequence[Motif] | None = None,
    z_threshold: float = baseline.Z_THRESHOLD, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Anomaly and motif detectors over a replay, rated against labels. No pruning, so no resets."""
    signals = baseline.deviation_signals(edges, hot_rows=hot_rows)
    completions = M.match_motifs(edges, motifs, hot_rows=hot_rows)
    return evaluation.detection_report(signals, completions, labels, z_threshold, hot_rows=hot_rows)


def score_replay(edges: DataFrame, top_n: int | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Scheduled scores of every entity after a replay, largest magnitude first."""
    z = baseline.latest_deviation(baseline.deviation_signals(edges, hot_rows=hot_rows))
    scores = graph.score_entities(edges, z)
    if top_n is not None:
        return graph.top_entities(scores, top_n)
    return scores.orderBy(F.desc(F.abs("score")), "entity_id")


def prune_replay(
    edges: DataFrame, pass_times: Sequence[float], policy: decay.PrunePolicy,
    config: DecayConfig | None = None,
) -> decay.PrunePass:
    """Pass after pass over the edges that have arrived, threshold from the live count.

    Each pass depends on the one before it, so they run in turn; the live set is written
    to the shared folder between passes. With a fixed threshold ``prune_schedule`` gives
    the same answer without passes.
    """
    live, colds, stats = None, [], []
    since = float("-inf")
    for t in sorted(pass_times):
        arrived = edges.filter((F.col("t_e") > since) & (F.col("t_e") <= F.lit(float(t))))
        live = arrived if live is None else live.unionByName(arrived)
        marked = materialize(decay.mark_prunable(live, t, policy, config))
        colds.append(decay.cold_records(marked, t))
        stats.append(decay.prune_stats(marked).withColumn("t", F.lit(float(t))))
        live = marked.filter(~F.col("prune")).select(*edges.columns)
        since = float(t)
    if live is None:
        raise ValueError("at least one pass time is needed")
    union = lambda frames: _union_all(frames)
    return decay.PrunePass(active=live, cold=union(colds), stats=union(stats))


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
