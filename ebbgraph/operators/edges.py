"""Edge table: normalising, validating, upserting, set operations, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.functions.columns import edge_id, node_type
from ebbgraph.schema import EDGE, EDGE_TYPES, NODE_TYPES, PROTOCOLS

REQUIRED = ("src", "dst", "edge_type", "protocol", "t_e", "w_0")


def normalize_edges(df: DataFrame) -> DataFrame:
    """Bring a frame to the edge layout, filling ids, node types and defaults."""
    given = set(df.columns)
    out = df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in EDGE.fields
        ]
    )
    derived = edge_id(F.col("src"), F.col("dst"), F.col("protocol"), F.col("t_e"))
    return out.withColumns(
        {
            "edge_id": F.coalesce("edge_id", derived),
            "src_type": F.coalesce("src_type", node_type(F.col("src"))),
            "dst_type": F.coalesce("dst_type", node_type(F.col("dst"))),
            "source_system": F.coalesce("source_system", F.lit("unknown")),
        }
    )


def failed_rules() -> Column:
    """Names of the contract rules an edge breaks (empty when valid)."""

    def rule(name: str, broken: Column) -> Column:
        return F.when(broken, F.lit(name))

    rules = [rule(f"{c} missing", F.col(c).isNull()) for c in REQUIRED]
    rules += [
        rule("edge_type unknown", ~F.col("edge_type").isin(*EDGE_TYPES)),
        rule("protocol unknown", ~F.col("protocol").isin(*PROTOCOLS)),
        rule("src_type unknown", ~F.col("src_type").isin(*NODE_TYPES)),
        rule("dst_type unknown", ~F.col("dst_type").isin(*NODE_TYPES)),
        rule("w_0 negative", F.col("w_0") < 0),
    ]
    return F.array_compact(F.array(*rules))


def validate_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid edges, rejected edges with a ``failed`` array)."""
    checked = edges.withColumn("failed", failed_rules())
    return checked.filter(F.size("failed") == 0).drop("failed"), checked.filter(F.size("failed") > 0)


def to_json(edges: DataFrame) -> DataFrame:
    """One JSON text per edge, keys sorted, nulls kept."""
    names = sorted(f.name for f in EDGE.fields)
    return edges.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """Parse JSON texts into edges; unknown fields are ignored, blank lines skipped."""
    parsed = F.inline(F.array(F.from_json("value", EDGE)))
    return normalize_edges(lines.filter(F.trim("value") != "").select(parsed))


def upsert_edges(writes: DataFrame, *order: str) -> DataFrame:
    """Last write per edge_id, by the given order columns (map-side combined)."""
    names = writes.columns
    last = F.max_by(F.struct(*names), F.struct(*order)).alias("_row")
    return writes.groupBy(F.col("edge_id").alias("_id")).agg(last).select("_row.*")


def remove_edges(edges: DataFrame, removed_ids: DataFrame) -> DataFrame:
    return edges.join(removed_ids.select("edge_id"), "edge_id", "left_anti")


def get_edges(edges: DataFrame, *edge_ids: str) -> DataFrame:
    return edges.filter(F.col("edge_id").isin(*edge_ids))


def union_edges(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def active_graph_size(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("active_edges"))


def replay_order(edges: DataFrame) -> DataFrame:
    """Time order, ties by edge_id. A global sort: only for results asked for in order."""
    return edges.orderBy("t_e", "edge_id")


def neighbors(edges: DataFrame, direction: str = "out", node: str | None = None) -> DataFrame:
    """(node, neighbor, edge_id) per incident edge; in ``both`` a self-loop counts once."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    out_row = F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbor"))
    in_row = F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbor"))
    rows = {
        "out": F.array(out_row),
        "in": F.array(in_row),
        "both": F.when(F.col("src") == F.col("dst"), F.array(out_row)).otherwise(F.array(out_row, in_row)),
    }[direction]
    if node is not None:
        ends = {"out": F.col("src") == node, "in": F.col("dst") == node}
        edges = edges.filter(ends.get(direction, ends["out"] | ends["in"]))
    result = edges.select(F.explode(rows).alias("r"), "edge_id").select("r.*", "edge_id")
    return result if node is None else result.filter(F.col("node") == node)
