"""Connected components of an edge table, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import drop, store


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b: longs); nodes with one root are connected.

    Each round maps a node to the smallest of itself and its neighbours, rewrites both ends of all
    edges, and drops loops and repeats; it ends when no edge is left. With ids in pseudo-random order
    (hash them) the rounds grow with the logarithm of a component's diameter. The minimum is
    pre-aggregated before the shuffle and the two joins are plain equi-joins, so a hub with very many
    neighbours is split by adaptive execution. Every round's tables are written to the shared folder
    and the ones before deleted; nothing but the question whether edges are left comes to the driver.
    """
    live = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("to")))
        if labels is None:
            merged = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            merged = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        merged = store(merged)
        left = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("p")), "a")
        both_ends = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("q")), "b").where("p <> q")
        fewer = store(both_ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        drop(live, step, labels)
        live, labels = fewer, merged
    drop(live)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    return labels
