"""Decay rates from the time between an entity's edges."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbgraph.config import DecayConfig
from ebbgraph.operators.decay import with_lambda
from ebbgraph.operators.scale import HOT_ROWS, dense_index, exact_median, materialize, prefix_sums, segment_hot

MIN_SAMPLES = 30
WINDOW_GAPS = 500
TICK_EDGES = 200
MAX_RELATIVE_CHANGE = 0.25

KEYS = ["src", "protocol"]

GapsBefore = Mapping[str, int] | DataFrame | None


def edge_gaps(
    edges: DataFrame, order: tuple[str, ...] = ("t_e", "edge_id"), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Every edge with ``gap``: seconds since the entity's previous edge of that protocol.

    Null for a first edge and for a gap that is not positive.
    """
    order = list(order)
    wanted = list(dict.fromkeys([*KEYS, "t_e", "edge_id", *order]))
    rows = edges.select(*wanted)
    cold, hot = segment_hot(rows, KEYS, order, hot_rows)
    previous = F.lag("t_e").over(Window.partitionBy(*KEYS).orderBy(*order))
    out = cold.withColumn("_before", previous)
    if hot is not None:
        last = hot.groupBy(*KEYS, "_seg").agg(F.max_by("t_e", "_pos").alias("_last"))
        carried = last.select(
            *KEYS, "_seg", F.lag("_last").over(Window.partitionBy(*KEYS).orderBy("_seg")).alias("_carried")
        )
        inside = F.lag("t_e").over(Window.partitionBy(*KEYS, "_seg").orderBy("_pos"))
        stitched = (
            hot.withColumn("_inside", inside)
            .join(F.broadcast(carried), [*KEYS, "_seg"])  # one row per segment
            .withColumn("_before", F.coalesce("_inside", "_carried"))
        )
        out = out.unionByName(stitched.select(*wanted, "_before"))
    gap = F.col("t_e") - F.col("_before")
    return out.select(*wanted, F.when(gap > 0, gap).alias("gap"))


def inter_arrival_gaps(edges: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Positive gaps only, one row each."""
    return edge_gaps(edges, hot_rows=hot_rows).filter(F.col("gap").isNotNull())


def calibrate_decay(
    edges: DataFrame, config: DecayConfig | None = None, min_samples: int = MIN_SAMPLES,
    hot_rows: int | None = HOT_ROWS, *, split: bool = True,
) -> DataFrame:
    """Suggested rate per configured protocol from its median gap."""
    config = config or DecayConfig()
    gaps = inter_arrival_gaps(edges, hot_rows)
    medians = exact_median(gaps, "protocol", "gap", split=split)
    current = F.broadcast(config.to_df(edges.sparkSession).select("protocol", "lambda_p"))
    count = F.coalesce("n", F.lit(0))
    median = F.when(count >= min_samples, F.col("median"))
    return medians.join(current, "protocol", "right").select(
        "protocol",
        count.alias("sample_count"),
        median.alias("median_gap_seconds"),
        (F.lit(math.log(2)) / median).alias("suggested_lambda_p"),
        (median / 3600.0).alias("suggested_half_life_hours"),
        F.col("lambda_p").alias("current_lambda_p"),
        (count >= min_samples).alias("sufficient_data"),
    )


def arrival_gaps(
    edges: DataFrame, order: tuple[str, ...] = ("t_e", "edge_id"), hot_rows: int | None = HOT_ROWS,
    split: bool = True,
) -> DataFrame:
    """Every edge with its gap and its ``arrival`` number (0, 1, 2, ...)."""
    return dense_index(edge_gaps(edges, order, hot_rows), list(order), "arrival", split=split)


def number_gaps(arrived: DataFrame, gaps_before: GapsBefore = None, split: bool = True) -> DataFrame:
    """(protocol, arrival, gap, number): positive gaps numbered 1, 2, ... per protocol."""
    rows = arrived.filter(F.col("gap").isNotNull()).select("protocol", "arrival", "gap")
    numbered = prefix_sums(rows, ["protocol"], ["arrival"], {"number": F.lit(1)}, split=split)
    return _with_before(numbered, gaps_before, "number")


def _before(spark: SparkSession, gaps_before: GapsBefore) -> DataFrame:
    """(protocol, before): gaps of a protocol seen in earlier batches, as a table."""
    if gaps_before is None or isinstance(gaps_before, Mapping):
        gaps_before = spark.createDataFrame(list((gaps_before or {}).items()), "protocol string, gaps long")
    return gaps_before.select("protocol", F.col("gaps").cast("long").alias("before"))


def _with_before(df: DataFrame, gaps_before: GapsBefore, number: str) -> DataFrame:
    """Add earlier batches' gaps to a running number."""
    if gaps_before is None:
        return df
    joined = df.join(_before(df.sparkSession, gaps_before), "protocol", "left")
    return joined.withColumn(number, F.col(number) + F.coalesce("before", F.lit(0))).drop("before")


def tick_medians(
    arrived: DataFrame, numbered: DataFrame, *, recent: DataFrame | None = None,
    gaps_before: GapsBefore = None, min_samples: int = MIN_SAMPLES,
    window_gaps: int = WINDOW_GAPS, tick_edges: int = TICK_EDGES, hot_rows: int | None = HOT_ROWS,
    split: bool = True,
) -> DataFrame:
    """(tick, t, protocol, sample_count, median): median of the newest gaps at each tick.

    A tick follows every ``tick_edges`` edges in arrival order. The window of a tick ends
    at the gap number its protocol has reached; windows that end at the same number are
    computed once. ``recent`` (protocol, number, gap) adds gaps of earlier batches.
    """
    tick = F.floor(F.col("arrival") / tick_edges)
    closing = F.col("arrival") % tick_edges == tick_edges - 1
    ticks = arrived.filter(closing).select(tick.alias("tick"), F.col("t_e").alias("t"))

    # gaps reached by each tick: a total holds from the tick that reaches it to the one before the next
    # total, and a protocol has no row before it has min_samples gaps
    added = numbered.groupBy("protocol", tick.alias("tick")).agg(F.count("*").alias("_added"))
    spark = arrived.sparkSession
    if gaps_before is not None:
        start = arrived.agg(F.min(tick).alias("tick"))
        carried = _before(spark, gaps_before).select("protocol", F.lit(0).cast("long").alias("_added"))
        added = added.unionByName(carried.join(F.broadcast(start), F.col("tick").isNotNull()).select("protocol", "tick", "_added"))  # one row
        added = added.groupBy("protocol", "tick").agg(F.sum("_added").alias("_added"))
    totals = prefix_sums(added, ["protocol"], ["tick"], {"upto": F.col("_added")}, split=split)
    totals = _with_before(totals, gaps_before, "upto").filter(F.col("upto") >= min_samples)
    end = arrived.agg(F.max(tick).alias("_end"))  # one row
    following = F.lead("tick").over(Window.partitionBy("protocol").orderBy("tick"))
    spans = totals.join(F.broadcast(end), F.col("_end").isNotNull()).withColumn("_last", F.coalesce(following - 1, F.col("_end")))
    reached = spans.select("protocol", "upto", F.explode(F.sequence("tick", "_last")).alias("tick")).join(ticks, "tick")

    gaps = numbered.select("protocol", "number", "gap")
    if recent is not None:
        gaps = gaps.unionByName(recent.select("protocol", "number", "gap"))
    medians = _window_medians(reached.select("protocol", "upto").distinct(), gaps, window_gaps)
    # a protocol that falls silent keeps the same number for all later ticks
    return reached.join(medians, ["protocol", "upto"]).select("tick", "t", "protocol", "sample_count", "median")


def _window_medians(windows: DataFrame, gaps: DataFrame, size: int) -> DataFrame:
    """(protocol, upto, sample_count, median) of the newest ``size`` gaps up to number ``upto``.

    Gaps of a protocol, numbered without holes, are packed into arrays of ``size``. A window lies in at most two of
    them, so it meets two rows, not its gaps one by one.
    """
    keys = ["protocol", "_bucket"]
    packed = F.array_sort(F.collect_list(F.struct("number", "gap")))
    blocks = (
        gaps.withColumn("_bucket", F.floor((F.col("number") - 1) / size))
        .groupBy(*keys).agg(packed.alias("_packed"))
        .select(*keys, F.col("_packed")[0]["number"].alias("_from"), F.col("_packed.gap").alias("_gaps"))
    )
    earlier = blocks.select("protocol", (F.col("_bucket") + 1).alias("_bucket"), F.col("_from").alias("_from_0"), F.col("_gaps").alias("_gaps_0"))

    def inside(values: str, start: str) -> Column:
        first = F.greatest(F.col("upto") - size + 1, F.col(start))
        last = F.least(F.col("upto"), F.col(start) + F.size(values) - 1)
        cut = F.slice(values, (first - F.col(start) + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
        return F.coalesce(cut, F.array().cast("array<double>"))

    met = (
        windows.withColumn("_bucket", F.floor((F.col("upto") - 1) / size))
        .join(blocks, keys, "left").join(earlier, keys, "left")
        .select("protocol", "upto", F.sort_array(F.concat(inside("_gaps", "_from"), inside("_gaps_0", "_from_0"))).alias("_window"))
    )
    n = F.size("_window")
    low, high = F.col("_window")[F.floor((n - 1) / 2).cast("int")], F.col("_window")[F.floor(n / 2).cast("int")]
    return met.filter(n > 0).select("protocol", "upto", n.alias("sample_count"), (low * 0.5 + high * 0.5).alias("median"))


def rolling_gap_medians(
    edges: DataFrame, *, order: tuple[str, ...] = ("t_e", "edge_id"), hot_rows: int | None = HOT_ROWS,
    split: bool = True, **options,
) -> DataFrame:
    """Rolling medians over a whole replay; see ``tick_medians`` for the options."""
    arrived = arrival_gaps(edges, order, hot_rows, split)
    numbered = number_gaps(arrived, split=split)
    return tick_medians(arrived, numbered, hot_rows=hot_rows, split=split, **options)


RECALIBRATION = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("previous_lambda_p", T.DoubleType()),
        T.StructField("suggested_lambda_p", T.DoubleType()),
        T.StructField("applied_lambda_p", T.DoubleType()),
        T.StructField("sample_count", T.IntegerType()),
        T.StructField("t", T.DoubleType()),
    ]
)


#: Ticks of a protocol that are walked as one array.
BLOCK_TICKS = 512


def _step_toward(current: Column, suggested: Column, change: float) -> Column:
    held = F.least(F.greatest(suggested, current * (1.0 - change)), current * (1.0 + change))
    return F.when(current <= 0, suggested).otherwise(held)


def _rate_after(entry: str, change: float) -> Column:
    """The rate at the end of a block that is entered with the rate in column ``entry``."""
    return F.aggregate("_ticks", F.col(entry), lambda rate, tick: _step_toward(rate, tick["suggested"], change))


def _rates_along(entry: str, change: float) -> Column:
    """The entry rate and the rate after each tick of a block."""
    after = lambda rates, tick: F.array(_step_toward(F.element_at(rates, -1), tick["suggested"], change))
    return F.aggregate("_ticks", F.array(entry), lambda rates, tick: F.concat(rates, after(rates, tick)))


def _block_entries(blocks: DataFrame, config: DecayConfig, change: float) -> DataFrame:
    """(protocol, _block, _entry): the rate in force when each block begins.

    A rate stays between the protocol's lowest and highest suggestion and its first rate, and a step keeps the
    order of two rates. So each block is walked from both bounds at once: where they end alike, its end is
    known whatever came before. Where not, it is walked again from the bounds that the block before ended with,
    until all are closed; each round closes at least the first open block of every protocol.
    """
    keys = ["protocol", "_block"]
    ends = blocks.groupBy("protocol").agg(F.min("_low").alias("_lowest"), F.max("_high").alias("_highest"), F.min("_block").alias("_first"))
    positive = F.when(F.col("lambda_p") > 0, F.col("lambda_p"))
    first = F.col("_block") == F.col("_first")
    exits = materialize(
        blocks.join(with_lambda(ends, config), "protocol").select(
            *keys, "_ticks",
            F.when(first, F.col("lambda_p")).otherwise(F.least("_lowest", positive)).alias("_lo"),
            F.when(first, F.col("lambda_p")).otherwise(F.greatest("_highest", positive)).alias("_hi"),
        ).select(*keys, "_lo", "_hi", _rate_after("_lo", change).alias("_out_lo"), _rate_after("_hi", change).alias("_out_hi"))
    )
    before = Window.partitionBy("protocol").orderBy("_block")  # a row for each block
    while True:
        now = exits.withColumns({
            "_now_lo": F.coalesce(F.lag("_out_lo").over(before), "_lo"), "_now_hi": F.coalesce(F.lag("_out_hi").over(before), "_hi"),
        })
        narrower = (F.col("_now_lo") != F.col("_lo")) | (F.col("_now_hi") != F.col("_hi"))
        again = (F.col("_out_lo") != F.col("_out_hi")) & narrower
        if now.filter(again).isEmpty():
            return now.select(*keys, F.col("_now_lo").alias("_entry"))
        walked = blocks.join(
            now.filter(again).select(*keys, F.col("_now_lo").alias("_lo"), F.col("_now_hi").alias("_hi")), keys
        ).select(*keys, "_lo", "_hi", _rate_after("_lo", change).alias("_out_lo"), _rate_after("_hi", change).alias("_out_hi"))
        exits = materialize(now.filter(~again).select(*exits.columns).unionByName(walked))


def recalibrate(
    medians: DataFrame, config: DecayConfig | None = None,
    max_relative_change: float = MAX_RELATIVE_CHANGE, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Rate changes tick by tick, each limited relative to the protocol's own previous rate.

    A protocol's ticks are cut into blocks of ``BLOCK_TICKS`` tick numbers (of ``hot_rows``, if fewer), each walked by
    itself from the rate that ``_block_entries`` finds for it.
    """
    size = min(hot_rows or BLOCK_TICKS, BLOCK_TICKS)
    suggested = (F.lit(math.log(2)) / F.col("median")).alias("suggested")
    ticks = medians.select("protocol", "tick", "t", "sample_count", suggested, F.floor(F.col("tick") / size).alias("_block"))
    blocks = materialize(
        ticks.groupBy("protocol", "_block").agg(
            F.array_sort(F.collect_list(F.struct("tick", "t", "sample_count", "suggested"))).alias("_ticks"),
            F.min("suggested").alias("_low"), F.max("suggested").alias("_high"),
        )
    )
    entries = _block_entries(blocks, config or DecayConfig(), max_relative_change)
    rates = blocks.join(entries, ["protocol", "_block"]).select(
        "protocol", "_ticks", _rates_along("_entry", max_relative_change).alias("_rates")
    )
    steps = F.transform("_ticks", lambda tick, i: F.struct(
        F.col("_rates")[i].alias("previous_lambda_p"), tick["suggested"].alias("suggested_lambda_p"),
        F.col("_rates")[i + 1].alias("applied_lambda_p"), tick["sample_count"].cast("int").alias("sample_count"), tick["t"].alias("t"),
    ))
    changes = F.filter(steps, lambda step: step["applied_lambda_p"] != step["previous_lambda_p"])
    return rates.select("protocol", F.explode(changes).alias("_step")).select("protocol", "_step.*").select(*RECALIBRATION.fieldNames())


def adaptive_recalibration(
    edges: DataFrame, config: DecayConfig | None = None,
    max_relative_change: float = MAX_RELATIVE_CHANGE, **options,
) -> DataFrame:
    return recalibrate(rolling_gap_medians(edges, **options), config, max_relative_change)


def apply_recalibration(config: DecayConfig, events: DataFrame) -> DecayConfig:
    """Config after a run of events: the newest applied rate per protocol (one row each)."""
    newest = events.groupBy("protocol").agg(F.max_by("applied_lambda_p", "t").alias("rate"))
    for row in newest.collect():
        config = config.with_lambda(row["protocol"], row["rate"])
    return config
