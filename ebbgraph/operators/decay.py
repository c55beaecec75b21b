"""Decay of edge weights and pruning of the active graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.config import MAX_CONFIG_ROWS, DecayConfig
from ebbgraph.functions.columns import decay_weight, epsilon
from ebbgraph.operators.scale import carry_last
from ebbgraph.schema import COLD_EDGE


def as_time(t: float | str | Column) -> Column:
    """A number is a fixed evaluation time, text names a column."""
    if isinstance(t, Column):
        return t
    return F.col(t) if isinstance(t, str) else F.lit(float(t))


def with_lambda(edges: DataFrame, config: DecayConfig | None = None) -> DataFrame:
    """Attach lambda_p by protocol; the rates are broadcast while the config is of a usual size."""
    config = config or DecayConfig()
    rates = config.to_df(edges.sparkSession).select("protocol", F.col("lambda_p").alias("_rate"))
    few = len(config.rates) <= MAX_CONFIG_ROWS
    joined = edges.join(F.broadcast(rates) if few else rates, "protocol", "left")
    return joined.select(
        *[c for c in edges.columns if c != "lambda_p"], F.coalesce("_rate", F.lit(config.default_lambda)).alias("lambda_p")
    )


def rates_in_force(edges: DataFrame, changes: DataFrame, config: DecayConfig | None = None) -> DataFrame:
    """Attach the lambda_p that held at each edge's own time.

    ``changes`` (protocol, t, applied_lambda_p; as from ``calibration.recalibrate``) hold from their time on; of two at one
    time the higher rate counts. Before its first change a protocol has its rate of ``config``. Edges and changes are
    sorted together and each edge takes the last change before it: no pairs, and no limit on either table.
    """
    kept = [c for c in edges.columns if c != "lambda_p"]
    rows = edges.select(*kept).withColumns({"_kind": F.lit(1), "_changed": F.lit(None).cast("double")})
    marks = changes.select("protocol", F.col("t").alias("t_e"), F.lit(0).alias("_kind"), F.col("applied_lambda_p").alias("_changed"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    found = carry_last(both, ["protocol"], ["t_e", "_kind", "_changed"], "_changed", "_held").filter(F.col("_kind") == 1)
    return with_lambda(found, config).select(*kept, F.coalesce("_held", "lambda_p").alias("lambda_p"))


def refresh_weights(
    edges: DataFrame, t: float | str | Column = "t_e", config: DecayConfig | None = None
) -> DataFrame:
    """Set ``w`` to the weight at time t and ``w_evaluated_at`` to t."""
    at = as_time(t)
    weight = decay_weight(F.col("w_0"), F.col("lambda_p"), F.col("t_e"), at)
    return (
        with_lambda(edges, config)
        .withColumns({"w": weight, "w_evaluated_at": at.cast("double")})
        .drop("lambda_p")
    )


def with_expiry(edges: DataFrame, eps: float, config: DecayConfig | None = None) -> DataFrame:
    """``expires_at``: the time after which the weight is below a fixed threshold.

    Null means never (a threshold of 0, or no decay above it); weights already
    below the threshold expire at minus infinity.
    """
    if eps < 0:
        raise ValueError("eps must not be negative")
    if eps == 0:
        return edges.withColumn("expires_at", F.lit(None).cast("double"))
    span = F.ln(F.col("w_0") / F.lit(float(eps))) / F.col("lambda_p")
    expires = (
        F.when(F.col("w_0") < eps, F.lit(float("-inf")))
        .when(F.col("lambda_p") > 0, F.col("t_e") + span)
    )
    return with_lambda(edges, config).withColumn("expires_at", expires).drop("lambda_p")


def active_at(edges: DataFrame, t: float, eps: float, config: DecayConfig | None = None) -> DataFrame:
    """Edges still at or above a fixed threshold at time t."""
    return refresh_weights(edges, t, config).filter(F.col("w") >= F.lit(float(eps)))


def prune_schedule(
    edges: DataFrame, first_pass: float, every: float, eps: float, config: DecayConfig | None = None
) -> DataFrame:
    """Fixed threshold: the pass at which each edge leaves, computed without replaying passes.

    Passes run at ``first_pass + k * every``; an edge is seen by passes from its own
    time on and leaves at the first one later than its expiry.
    """
    first, step = F.lit(float(first_pass)), F.lit(float(every))
    seen = F.ceil((F.col("t_e") - first) / step)
    expired = F.when(F.col("expires_at") == float("-inf"), F.lit(0)).otherwise(
        F.floor((F.col("expires_at") - first) / step) + 1
    )
    number = F.greatest(F.lit(0), seen, expired)
    return with_expiry(edges, eps, config).withColumn(
        "pruned_at", F.when(F.col("expires_at").isNotNull(), first + number * step)
    )


@dataclass(frozen=True)
class PrunePolicy:
    epsilon_min: float = 0.05
    epsilon_max: float = 0.5
    low_watermark: float = 70.0
    high_watermark: float = 90.0
    max_edges: int | None = None
    memory_percent: float | None = None

    def epsilon(self, edge_count: Column) -> Column:
        return epsilon(
            edge_count, self.epsilon_min, self.epsilon_max, self.low_watermark,
            self.high_watermark, self.max_edges, self.memory_percent,
        )


def epsilon_at(edges: DataFrame, policy: PrunePolicy) -> DataFrame:
    """One row: scanned count and the threshold it leads to."""
    return edges.agg(F.count("*").alias("scanned")).select(
        "scanned", policy.epsilon(F.col("scanned")).alias("epsilon")
    )


def mark_prunable(
    edges: DataFrame, t: float, policy: PrunePolicy, config: DecayConfig | None = None
) -> DataFrame:
    """Weight at t, the pass threshold and a ``prune`` flag for every live edge.

    Only size pressure needs the count of live edges; otherwise the threshold is a constant.
    """
    refreshed = refresh_weights(edges, t, config)
    if policy.max_edges:
        threshold = epsilon_at(edges, policy).select("epsilon").scalar()
    else:
        threshold = policy.epsilon(F.lit(0))
    return refreshed.withColumn("epsilon", threshold).withColumn("prune", F.col("w") < F.col("epsilon"))


@dataclass(frozen=True)
class PrunePass:
    active: DataFrame
    cold: DataFrame
    stats: DataFrame


def cold_records(marked: DataFrame, t: float | str | Column) -> DataFrame:
    return (
        marked.filter("prune")
        .withColumns({"w_at_prune": F.col("w"), "pruned_at": as_time(t).cast("double")})
        .select(*COLD_EDGE.fieldNames())
    )


def prune_stats(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count("*").alias("scanned"),
        F.count_if("prune").alias("pruned"),
        F.max("epsilon").alias("epsilon"),
        F.lit(0).cast("long").alias("write_failures"),
    )


def prune_pass(
    edges: DataFrame, t: float, policy: PrunePolicy, config: DecayConfig | None = None
) -> PrunePass:
    """One scan: edges kept, cold records of edges removed, and the pass counts."""
    marked = mark_prunable(edges, t, policy, config)
    return PrunePass(
        active=marked.filter(~F.col("prune")).select(*edges.columns),
        cold=cold_records(marked, t),
        stats=prune_stats(marked),
    )
