"""Merkle manifest of a dataset: a digest tree over each group's rows, a tree over the groups, a proof for every row.

Leaves ascend within their group and get places by range partitions with offsets, so a group that holds
a third of all rows is spread like any other. ``fanout ** BLOCK_LEVELS`` consecutive leaves make an aligned
block, one row whose lower levels are array expressions. Blocks then exchange roots as in a butterfly:
in round r, each block meets the blocks of its ``fanout`` neighbouring subtrees (of fanout^r blocks each)
that have its own number within their subtree. Every group of partners has at most ``fanout`` rows, all
its members hash the common ancestor for themselves and append the siblings to their own proof. After
the last round each block knows the root and its whole upper proof; nothing travels down again. In a
last, shorter subtree a block also answers for the numbers that it lacks, so no partner goes without.
The groups' roots go through the same exchange.

Defined results: fields that are null are hashed as ``-``, empty ones as ``0:``; a null group is a group of
its own and comes first, and so does a null order value within its group; rows of equal order value go by
leaf digest, so repeated rows differ in their proofs only; an empty table gives an empty result; extra
columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import drop, store
from ebbgraph.operators.scale import dense_index

FANOUT = 16
BLOCK_LEVELS = 2
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as its byte count and itself; a null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(nodes: Column, fanout: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(fanout))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(nodes, s, fanout), ""), 256))


def _step(nodes: Column, at: Column, fanout: int) -> Column:
    """The siblings of node number ``at`` (from 0) in its run, left and right of it."""
    inside = at % fanout
    return F.struct(
        F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("left"),
        F.array_join(F.slice(nodes, at + 2, F.lit(fanout - 1) - inside), "").alias("right"),
    )


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tree, at, node, proof: every participant's root and its proof to it, from (tree, n, at, node).

    ``at`` numbers the n nodes of a tree from 0. One round for each level of the largest tree; trees that
    are complete wait.
    """
    state = store(nodes.select("tree", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"), "node", F.array().cast(STEPS).alias("proof")))
    most = state.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < most:
        span = F.lit(width)
        subtree = F.floor(F.col("at") / span).cast("long")
        placed = state.select("*", (subtree / fanout).cast("long").alias("up"), (F.col("at") % span).alias("low"), (subtree % fanout).cast("int").alias("digit"),
                              F.least(span.cast("long"), F.col("n") - subtree * span).alias("held")).where(F.col("n") > span)
        sent = placed.select("tree", "up", F.explode(F.sequence(F.col("low"), span.cast("long") - 1, F.col("held"))).alias("low"), "digit", "node")
        runs = sent.groupBy("tree", "up", "low").agg(F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("run"))  # fanout rows at most
        met = placed.join(runs, ["tree", "up", "low"]).select(
            "tree", "n", "at", F.col("run.node").alias("run"), "digit", "proof"
        )
        grown = met.select(
            "tree", "n", "at", F.sha2(F.array_join("run", ""), 256).alias("node"),
            F.concat("proof", F.array(_step(F.col("run"), F.col("digit"), fanout))).alias("proof"),
        )
        later = store(grown.unionByName(state.where(F.col("n") <= span)))
        drop(state)
        state, width = later, width * fanout
    return state.select("tree", "at", "node", "proof")


def manifest(
    docs: DataFrame, values: Mapping[str, Column], group: str, order: str, carry: Mapping[str, Column] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """Per row: the order column, leaf, subroot (of its group), root (of all), proof (leaf to root), and ``carry``.

    ``values`` are the hashed fields in order; ``group`` and ``order`` name columns of ``docs``. Texts are read
    once; all else works on rows of digests.
    """
    carry = dict(carry or {})
    block = fanout**BLOCK_LEVELS
    key = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))  # a null group first
    rows = docs.select(key.alias("tree"), F.col(order).alias("order"), leaf(list(values.values())).alias("leaf"), F.struct(*[c.alias(n) for n, c in carry.items()] or [F.lit(0).alias("none")]).alias("extra"))
    placed = store(dense_index(rows, ["tree", "order", "leaf"]))
    trees = store(placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("idx").alias("first")))
    at = F.col("idx") - F.col("first")
    members = placed.join(trees, "tree").select(
        "tree", "n", F.floor(at / block).cast("long").alias("at"), F.struct(at.alias("place"), "order", "leaf", "extra").alias("row")
    )
    blocks = members.groupBy("tree", "n", "at").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # a block's rows at most
    blocks = blocks.withColumn("level0", F.col("rows.leaf"))
    for level in range(BLOCK_LEVELS):
        parents = F.when(F.col("n") > fanout**level, _parents(F.col(f"level{level}"), fanout)).otherwise(F.array().cast("array<string>"))
        blocks = blocks.withColumn(f"level{level + 1}", parents)
    blocks = store(blocks)  # levels as stored columns: later lambdas read them, they do not compute them again
    top = F.coalesce(*[F.get(f"level{level}", F.lit(0)) for level in range(BLOCK_LEVELS, -1, -1)])
    per_tree = F.ceil(F.col("n") / block).cast("long")
    paths = butterfly(blocks.select("tree", per_tree.alias("n"), "at", top.alias("node")), fanout)

    groups = trees.count()
    subroots = dense_index(paths.where("at = 0").select("tree", "node"), ["tree"])
    whole = butterfly(subroots.select(F.lit("").alias("tree"), F.lit(groups).alias("n"), F.col("idx").alias("at"), "node"), fanout)
    roots = subroots.join(whole.select(F.col("at").alias("idx"), F.col("node").alias("root"), F.col("proof").alias("rest")), "idx").select("tree", "root", "rest")
    upper = store(paths.withColumnRenamed("node", "subroot").join(roots, "tree").select("tree", "at", "subroot", "root", F.concat("proof", "rest").alias("upper")))

    def proof(i: Column) -> Column:
        steps = [F.when(F.col("n") > fanout**level, F.array(_step(F.col(f"level{level}"), F.floor(i / fanout**level).cast("int"), fanout))).otherwise(F.array().cast(STEPS)) for level in range(BLOCK_LEVELS)]
        return F.concat(*steps, F.col("upper"))

    def proven(row: Column, i: Column) -> Column:
        return F.struct(row["order"].alias(order), row["leaf"].alias("leaf"), proof(i).alias("proof"), row["extra"].alias("extra"))

    joined = blocks.join(upper, ["tree", "at"])
    each = joined.select("subroot", "root", F.inline(F.transform("rows", proven)))
    return each.select(order, "leaf", "subroot", "root", "proof", *[F.col(f"extra.{n}").alias(n) for n in carry])
