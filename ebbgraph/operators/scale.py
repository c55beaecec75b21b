"""Helpers that keep ordered, per-key work balanced when one key dominates.

Most keys are handled by an ordinary window or grouped fold. A key too large for
one task is cut into consecutive segments by range partitioning on (key, order);
each segment is processed on its own and a small per-segment summary carries the
result of earlier segments forward. The number of segments, hot keys and
summaries is bounded by the partition count, so those tables may be broadcast.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS: int | None = None  # rows from which a key is split; None: twice an average partition, and ``LEAST_HOT``
LEAST_HOT = 1_000_000  # fewer rows than these fit any task

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="ebbgraph-"))
    return _local_scratch[0]


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/ebbgraph-{uuid.uuid4().hex}"


_stored: list[list[tuple[SparkSession, str]]] = [[]]


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete at the end what ``materialize`` stores inside: for work whose results are written by then."""
    _stored.append([])
    try:
        yield
    finally:
        for spark, path in _stored.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, *folders: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession)
    _stored[-1].append((df.sparkSession, path))
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside only."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# --- global order ------------------------------------------------------------


def range_segments(df: DataFrame, order: Sequence[str], segments: int) -> DataFrame:
    """Rows in ``segments`` balanced consecutive ranges, stored with ``_seg`` and ``_pos``.

    Stored because a recomputed range partitioning may place its bounds elsewhere.
    """
    row_id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(segments, *order).sortWithinPartitions(*order)
    return materialize(
        ranged.withColumn("_row", row_id).select(
            *df.columns,
            F.shiftright("_row", 33).cast("int").alias("_seg"),
            F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
        )
    )


def dense_index(
    df: DataFrame, order: Sequence[str], name: str = "idx", *, split: bool = True
) -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without a one-task sort of large input."""
    if not split:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranged = range_segments(df, order, parallelism(df.sparkSession))
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per segment
        ranged.groupBy("_seg").agg(F.count("*").alias("_n"))
        .select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_seg")
        .withColumn(name, F.col("_pos") + F.col("_offset"))
        .drop("_seg", "_pos", "_offset")
    )


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
    *, split: bool = True,
) -> DataFrame:
    """Inclusive running totals per key in a total order; balanced even for a single key."""
    keys, order = list(keys), list(order)
    if not split:
        running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(running) for name, value in sums.items()})
    ranged = range_segments(df, [*keys, *order], parallelism(df.sparkSession))
    inside = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_seg").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = totals.select(
        *keys, "_seg", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = ranged.withColumns({f"_l_{n}": F.sum(v).over(inside) for n, v in sums.items()})
    return local.join(offsets, [*keys, "_seg"]).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``name``: the newest value of column ``value`` that is not null, at or before each row of its key.

    Rows are cut into balanced ranges, and each range hands on one value a key, so a single key may hold all rows.
    """
    keys, order = list(keys), list(order)
    ranged = range_segments(df, [*keys, *order], parallelism(df.sparkSession))
    inside = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    newest = ranged.groupBy(*keys, "_seg").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_newest")
    )
    carried = newest.select(*keys, "_seg", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    local = ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried, [*keys, "_seg"]).select(*df.columns, F.coalesce("_inside", "_carried").alias(name))


# --- hot keys ------------------------------------------------------------------


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """Keys too large for one task, with their row count ``_n``; None when there are none.

    Keys are counted with partial aggregation whatever the input's size. By default a key is hot
    above twice the rows of an average shuffle partition, so there are fewer than half as many as
    partitions. With ``hot_rows`` at most four per partition are returned: any further key holds a
    smaller share of the rows than a quarter of an average partition, so it needs no splitting.
    """
    spark = df.sparkSession
    relative = hot_rows is None
    hot_rows = LEAST_HOT if relative else hot_rows
    found = (
        df.groupBy(*keys).agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), *keys)
        .limit(4 * parallelism(spark))
    )
    rows = found.collect()
    if rows and relative:
        average = df.count() / parallelism(spark)
        rows = [row for row in rows if row["_n"] > 2 * average]
    return spark.createDataFrame(rows, found.schema) if rows else None


def segment_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Split a frame into (rows of ordinary keys, segmented rows of hot keys or None).

    There are at most four segments for each shuffle partition, whatever the rows.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df, None
    total = hot.agg(F.sum("_n")).first()[0]
    segments = max(2, min(math.ceil(total / (hot_rows or LEAST_HOT)), 4 * parallelism(df.sparkSession)))
    names = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    marked = df.join(names, keys, "left").select(*df.columns, F.coalesce("_hot", F.lit(False)).alias("_hot"))
    marked = materialize(marked, "_hot")  # read again by the range sampling and both parts
    hot_part = range_segments(marked.filter("_hot").drop("_hot"), [*keys, *order], segments)
    return marked.filter(~F.col("_hot")).drop("_hot"), hot_part


# --- sequential folds -----------------------------------------------------------

Fold = Callable[[str | None, pd.DataFrame], tuple[list[tuple], str | None]]
Finish = Callable[[tuple, str | None], list[tuple]]


def _runs(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive stretches of one key in key-sorted rows."""
    columns = [rows[k].to_numpy() for k in keys]
    change = np.zeros(len(rows), dtype=bool)
    change[:1] = True
    for values in columns:
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change)
    for start, end in zip(starts, [*starts[1:], len(rows)]):
        yield tuple(values[start] for values in columns), rows.iloc[start:end]


def _folding(
    keys: list[str], fold: Fold, entry: Callable[[tuple], str | None],
    close: Finish, names: list[str], emit: bool = True,
) -> Callable:
    """A partition function that folds key after key, holding one batch and one state."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            out: list[tuple] = []
            for this, part in _runs(rows, keys):
                if this != key:
                    if key is not None:
                        out += close(key, state)
                    key, state = this, entry(this)
                found, state = fold(state, part)
                if emit:
                    out += found
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame(close(key, state), columns=names)

    return run


def _by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def fold_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, finish: Finish,
    schema: T.StructType, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Run a state machine over each key's rows in order.

    ``fold(state, rows)`` returns (output rows, next state), the state being text or
    None; a key's rows may come in several calls. ``finish(key, state)`` adds rows for
    the state left at the end of a key. Rows stream through sorted partitions, so no key
    is held in memory.

    A hot key's segments run side by side from a guessed entry state; segments whose
    guess was wrong run again until every entry equals the exit before it, so the
    result is the sequential one whatever the data.
    """
    keys, order = list(keys), list(order)
    names = schema.fieldNames()
    cold, hot = segment_hot(df, keys, order, hot_rows)
    result = _by_key(cold, keys, order).mapInPandas(
        _folding(keys, fold, lambda key: None, finish, names), schema
    )
    if hot is None:
        return result

    entries = _settle_entries(hot, keys, fold)
    last: dict[tuple, int] = {}
    for *key, seg in entries:
        last[tuple(key)] = max(seg, last.get(tuple(key), seg))

    def close(group: tuple, state: str | None) -> list[tuple]:
        return finish(group[:-1], state) if group[-1] == last[group[:-1]] else []

    seg_keys = [*keys, "_seg"]
    segments = _by_key(hot, seg_keys, ["_pos"])
    return result.unionByName(
        segments.mapInPandas(_folding(seg_keys, fold, entries.__getitem__, close, names), schema)
    )


def _settle_entries(hot: DataFrame, keys: list[str], fold: Fold) -> dict[tuple, str | None]:
    """Entry state of every (key..., segment); one short text per segment reaches the driver."""
    spark = hot.sparkSession
    seg_keys = [*keys, "_seg"]
    key_fields = [hot.schema[k] for k in seg_keys]
    exit_schema = T.StructType([*key_fields, T.StructField("_exit", T.StringType())])
    names = exit_schema.fieldNames()
    entries: dict[tuple, str | None] = {}
    exits: dict[tuple, str | None] = {}
    todo = hot
    while True:
        leave = _folding(
            seg_keys, fold, dict(entries).get, lambda group, state: [(*group, state)], names, emit=False
        )
        for row in _by_key(todo, seg_keys, ["_pos"]).mapInPandas(leave, exit_schema).collect():
            exits[tuple(row)[:-1]] = row["_exit"]
        settled: dict[tuple, str | None] = {}
        previous = None
        for group in sorted(exits):
            follows = previous is not None and previous[:-1] == group[:-1]
            settled[group] = exits[previous] if follows else None
            previous = group
        changed = [group for group in settled if settled[group] != entries.get(group)]
        entries = settled
        if not changed:
            return entries
        wrong = spark.createDataFrame(changed, T.StructType(key_fields))
        todo = hot.join(F.broadcast(wrong), seg_keys, "left_semi")


# --- exact median ----------------------------------------------------------------


def exact_median(df: DataFrame, group: str, value: str, *, split: bool = True) -> DataFrame:
    """Exact count and median of positive values per group, for few large groups.

    Two histograms narrow the search to a thin slice of values, and only
    that slice is counted value by value, so no task holds a whole group.
    """
    rows = df.select(group, value).filter(F.col(value).isNotNull())
    if not split:
        return rows.groupBy(group).agg(F.count("*").alias("n"), F.median(value).alias("median"))
    rows = materialize(rows).withColumn("_b1", F.floor(F.log2(value) * 64))

    def locate(counts: DataFrame, within: list[str], order: str) -> DataFrame:
        """Bins that hold one of the two middle ranks; ``_base`` rows lie below the bin."""
        running = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("_upto", F.col("_base") + F.sum("_c").over(running))
        placed = placed.withColumn("_base", F.col("_upto") - F.col("_c"))
        return placed.filter(
            F.col("_lo").between(F.col("_base"), F.col("_upto") - 1)
            | F.col("_hi").between(F.col("_base"), F.col("_upto") - 1)
        )

    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    ranks = sizes.select(
        group, "n", F.floor((F.col("n") - 1) / 2).alias("_lo"), F.floor(F.col("n") / 2).alias("_hi"),
        F.lit(0).cast("long").alias("_base"),
    )
    coarse = rows.groupBy(group, "_b1").agg(
        F.count("*").alias("_c"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    # at most two bins per group from here on
    coarse = locate(coarse.join(ranks, group), [group], "_b1").drop("_c", "_upto")
    share = (F.col(value) - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0))
    sliced = rows.join(F.broadcast(coarse), [group, "_b1"]).withColumn(
        "_b2", F.floor(F.coalesce(share, F.lit(0.0)) * 65536)
    )
    carried = ["n", "_lo", "_hi", "_base"]
    fine = sliced.groupBy(group, "_b1", "_b2", *carried).agg(F.count("*").alias("_c"))
    fine = locate(fine, [group, "_b1"], "_b2").select(group, "_b1", "_b2", *carried)
    thin = sliced.drop(*carried).join(F.broadcast(fine), [group, "_b1", "_b2"])
    exact = thin.groupBy(group, "_b1", "_b2", value, *carried).agg(F.count("*").alias("_c"))
    exact = locate(exact, [group, "_b1", "_b2"], value)

    def holds(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("_base"), F.col("_upto") - 1), F.col(value)))

    return exact.groupBy(group).agg(
        F.max("n").alias("n"), ((holds("_lo") + holds("_hi")) / 2).alias("median")
    )
