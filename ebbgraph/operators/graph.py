"""Graph views of the active edges: dense index, partitions, neighbour-averaged scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.functions.columns import shard_index
from ebbgraph.operators.scale import dense_index, materialize

FEATURES = 8
HIDDEN = 16


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def edge_index(
    edges: DataFrame, *, split: bool = True
) -> tuple[DataFrame, DataFrame]:
    """((node, idx), (edge_id, src_idx, dst_idx)) with dense numbers in node-id order."""
    numbered = dense_index(nodes(edges), ["node"], "idx", split=split)
    ends = edges.select("edge_id", "src", "dst")
    for end in ("src", "dst"):
        side = numbered.select(F.col("node").alias(end), F.col("idx").alias(f"{end}_idx"))
        ends = ends.join(side, end)
    return numbered, ends.select("edge_id", "src_idx", "dst_idx")


def partition_edges(edges: DataFrame, shards: int, key: str = "edge_id") -> DataFrame:
    """Stable shard number per edge (or per chain key)."""
    return edges.withColumn("shard", shard_index(F.col(key), shards))


def write_partitioned(edges: DataFrame, path: str, shards: int, key: str = "edge_id") -> None:
    partition_edges(edges, shards, key).write.mode("overwrite").partitionBy("shard").parquet(path)


# --- scoring ---------------------------------------------------------------------


def base_feature(node: Column, i: int) -> Column:
    """Fixed feature i of a node in [-0.5, 0.5], from four hex digits of its md5."""
    return F.conv(F.substring(F.md5(node), 4 * i + 1, 4), 16, 10).cast("double") / 65535.0 - 0.5


def weight(layer: int, row: int, col: int) -> float:
    """Fixed untrained weight in [-0.5, 0.5]."""
    x = math.sin(12.9898 * (row + 1) + 78.233 * (col + 1) + 37.719 * layer) * 43758.5453
    return round(x - math.floor(x) - 0.5, 6)


def _affine(layer: int, unit: int, own: list[str], near: list[str]) -> str:
    """SQL text: bias + weighted own values + weighted neighbour means for one unit."""
    terms = [f"{weight(layer, unit, i)!r}D * {name}" for i, name in enumerate(own)]
    terms += [f"{weight(layer, unit, 100 + i)!r}D * coalesce({name}, 0D)" for i, name in enumerate(near)]
    return " + ".join([f"{weight(layer, unit, 999)!r}D", *terms])


def edge_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, n): parallel edges collapsed to a count before anything is joined."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def linked_pairs(edges: DataFrame) -> DataFrame:
    """Pairs plus one row (n = 0) per node that carries the node's own values to itself.

    Written once to the shared folder: both scoring rounds read it.
    """
    pairs = edge_pairs(edges)
    own = nodes(pairs).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("n"))
    return materialize(pairs.unionByName(own))


def gather(
    pairs: DataFrame, features: DataFrame, names: list[str]
) -> DataFrame:
    """Own values and mean in-neighbour values per node, in one join and one aggregation.

    ``pairs`` comes from ``linked_pairs``. Partial aggregation absorbs nodes with many
    incoming edges, salting those with many outgoing ones.
    """
    rows = pairs.join(features.withColumnRenamed("node", "src"), "src")
    itself = F.col("n") == 0
    return rows.groupBy(F.col("dst").alias("node")).agg(
        *[F.max(F.when(itself, F.col(c))).alias(c) for c in names],
        *[(F.sum(F.col(c) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias(f"near_{c}") for c in names],
    )


def neighbour_means(
    pairs: DataFrame, features: DataFrame, names: list[str]
) -> DataFrame:
    """Mean of in-neighbour features per node that has incoming edges."""
    rows = pairs.join(features.withColumnRenamed("node", "src"), "src")
    return rows.groupBy(F.col("dst").alias("node")).agg(
        *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"near_{c}") for c in names]
    )


def score_entities(
    edges: DataFrame, deviations: DataFrame, only: DataFrame | None = None
) -> DataFrame:
    """(entity_id, score) for every node: two rounds of neighbour averaging, then a linear head.

    ``deviations`` has (entity, z_score); ``only`` (entity_id) restricts the result.
    """
    links = linked_pairs(edges)
    every = links.filter(F.col("n") == 0).select(F.col("src").alias("node"))
    latest = deviations.select(F.col("entity").alias("node"), F.col("z_score").alias("_z"))
    names = [f"x{i}" for i in range(FEATURES)] + ["z"]
    values = every.join(latest, "node", "left").select(
        "node",
        *[base_feature(F.col("node"), i).alias(f"x{i}") for i in range(FEATURES)],
        F.coalesce("_z", F.lit(0.0)).alias("z"),
    )
    for layer in (1, 2):
        gathered = gather(links, values, names)
        near = [f"near_{c}" for c in names]
        units = [f"greatest(0D, {_affine(layer, u, names, near)}) AS h{u}" for u in range(HIDDEN)]
        values = gathered.selectExpr("node", *units)
        names = [f"h{u}" for u in range(HIDDEN)]
    scored = values.selectExpr("node AS entity_id", f"{_affine(3, 0, names, [])} AS score")
    return scored if only is None else scored.join(only.select("entity_id").distinct(), "entity_id", "left_semi")


def scheduled_scores(edges: DataFrame, deviations: DataFrame, t: float) -> DataFrame:
    return score_entities(edges, deviations).select(
        "entity_id", "score", F.lit(float(t)).alias("t"), F.lit("scheduled").alias("trigger"),
        F.lit(None).cast("string").alias("motif_name"),
    )


def alert_neighborhood(completions: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain_key, entity_id): each alerted entity with its live neighbours.

    Works per distinct alerted entity, so it grows with the edges and not with
    alerts times neighbours.
    """
    alerted = completions.select("chain_key").distinct()
    both_ways = F.array(
        F.struct(F.col("src").alias("chain_key"), F.col("dst").alias("entity_id")),
        F.struct(F.col("dst").alias("chain_key"), F.col("src").alias("entity_id")),
    )
    near = edges.select(F.explode(both_ways).alias("p")).select("p.*").join(alerted, "chain_key", "left_semi")
    itself = alerted.select("chain_key", F.col("chain_key").alias("entity_id"))
    return near.select("chain_key", "entity_id").union(itself).distinct()


def scoring_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """The edges that the scores of ``entities`` (entity_id) depend on: two rounds of averaging reach the
    in-neighbours' in-edges. Two semi-joins; whatever is grouped afterwards grows with the entities."""
    wanted = entities.select(F.col("entity_id").alias("dst")).distinct()
    near = edges.join(wanted, "dst", "left_semi")
    reached = near.select(F.col("src").alias("dst")).unionByName(wanted).distinct()
    return edges.join(reached, "dst", "left_semi")


def score_alert_neighborhoods(
    completions: DataFrame, edges: DataFrame, deviations: DataFrame
) -> DataFrame:
    """Scores around alerted entities, one row per (motif, alerted entity, neighbour).

    ``t`` is the newest completion and ``alerts`` their number; ``per_alert`` lists each
    completion separately. Edges that cannot reach an alerted neighbourhood are left out
    before anything is averaged.
    """
    area = alert_neighborhood(completions, edges)
    needed = scoring_edges(edges, area).select("src", "dst")  # every edge at an alerted entity ends in the area
    scores = score_entities(needed, deviations)
    alerts = completions.groupBy("chain_key", "motif_name").agg(
        F.max("completed_at").alias("t"), F.count("*").alias("alerts")
    )
    rated = area.join(scores, "entity_id")
    return rated.join(alerts, "chain_key").select(
        "entity_id", "score", "t", F.lit("motif_completion").alias("trigger"), "motif_name",
        "chain_key", "alerts",
    )


def per_alert(neighborhood_scores: DataFrame, completions: DataFrame) -> DataFrame:
    """One row per completion and neighbour; its size is what the caller asks for."""
    each = completions.select("motif_name", "chain_key", F.col("completed_at").alias("t"))
    return neighborhood_scores.drop("t", "alerts").join(each, ["motif_name", "chain_key"]).select(
        "entity_id", "score", "t", "trigger", "motif_name", "chain_key"
    )


def top_entities(scores: DataFrame, n: int) -> DataFrame:
    """Largest scores by magnitude, ties by id."""
    return scores.orderBy(F.desc(F.abs("score")), "entity_id").limit(n)
