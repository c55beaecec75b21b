"""Exponentially weighted baseline per (entity, protocol) and deviation scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbgraph.operators.scale import HOT_ROWS, materialize, segment_hot

ALPHA = 0.3
MIN_PRIOR_ROWS = 2
Z_THRESHOLD = 3.0

KEYS = ["entity", "protocol"]
ORDER = ["t", "edge_id"]
SIGNAL = [
    *KEYS, "t", "value", "baseline_mean", "baseline_std", "sample_count", "z_score", "edge_id"
]


class _Decayed:
    """Running sum of ``gain * q**age * x`` in O(1) per row, inside blocks that cannot overflow.

    Within a block the sum is taken over values scaled by q**-position; the values at
    the ends of earlier blocks are folded in with ``last`` over the preceding rows.
    """

    def __init__(self, groups: list[str], alpha: float) -> None:
        self.q = 1.0 - alpha
        rate = -math.log(self.q)
        self.block = max(16, math.ceil(20.0 / rate))  # q**-block stays near e**20, however small alpha
        self.levels = max(1, math.ceil(40.0 / (rate * self.block)))
        self.rows = Window.partitionBy(*groups, "_blk").orderBy("rn")
        self.inside = self.rows.rowsBetween(Window.unboundedPreceding, 0)
        self.ordered = Window.partitionBy(*groups).orderBy("_blk", "rn")
        self.before = self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def power(self, exponent: Column) -> Column:
        return F.pow(F.lit(self.q), exponent)

    def blocks(self, df: DataFrame) -> DataFrame:
        zero_based = F.col("rn") - 1
        return df.withColumns(
            {"_blk": F.floor(zero_based / self.block), "_at": zero_based % self.block}
        )

    def running(self, df: DataFrame, name: str, value: Column, carried: Column | None) -> DataFrame:
        """Add ``name``; ``carried`` is the sum before the first row of the group."""
        scaled = F.sum(value * self.power(-F.col("_at"))).over(self.inside)
        ends = F.col("_at") == self.block - 1
        df = df.withColumn("_in", scaled * self.power(F.col("_at"))).withColumn("_prev", F.lit(0.0))
        for _ in range(self.levels):
            closing = F.when(ends, F.col("_in") + F.col("_prev") * self.q**self.block)
            df = df.withColumn("_end", closing)
            df = df.withColumn("_prev", F.coalesce(F.last("_end", True).over(self.before), F.lit(0.0)))
        total = F.col("_in") + F.col("_prev") * self.power(F.col("_at") + 1)
        if carried is not None:
            total = total + carried * self.power(F.col("rn"))
        return df.withColumn(name, total).drop("_in", "_prev", "_end")


def _walk(df: DataFrame, groups: list[str], alpha: float, carry: bool = False) -> DataFrame:
    """Mean, step and variance columns for rows that have rn (1-based within ``groups``), the
    key's first value ``_first`` and, with ``carry``, the mean state left by earlier segments.
    The variance counts this segment's own steps only."""
    run = _Decayed(groups, alpha)
    n_in = F.col("_n_in") if carry else F.lit(0)
    m_in = F.col("_m_in") if carry else None

    df = run.blocks(df).withColumn("_y", F.col("value") - F.col("_first"))
    df = run.running(df, "_m", F.lit(alpha) * F.col("_y"), m_in)
    start = m_in if carry else F.lit(0.0)
    df = df.withColumn("_m0", F.coalesce(F.lag("_m").over(run.ordered), start))
    step = F.col("_y") - F.col("_m0")
    # a difference of a few units in the last place is no difference
    size = F.greatest(F.abs("value"), F.abs(F.col("_m0") + F.col("_first")))
    step = F.when(F.abs(step) <= size * 4e-16, F.lit(0.0)).otherwise(step)
    first_row = (F.col("rn") == 1) & (n_in == 0)
    df = df.withColumn("_step", F.when(first_row, F.lit(0.0)).otherwise(step))
    df = run.running(df, "_v", F.lit(alpha * run.q) * F.col("_step") * F.col("_step"), None)
    moved = F.coalesce(F.max(F.abs("_y")).over(run.before), F.lit(0.0))
    if carry:
        moved = F.greatest(moved, F.col("_moved_in"))
    return df.withColumns(
        {
            "_v0": F.coalesce(F.lag("_v").over(run.ordered), F.lit(0.0)),
            "_moved": moved, "_count": F.col("rn") + n_in,
        }
    )


def _signals(walked: DataFrame) -> DataFrame:
    # rounding keeps the spread of a history that has changed once from reaching zero
    mean_before = F.col("_m0") + F.col("_first")
    floor = F.when(F.col("_moved") > 0, F.abs(mean_before) * 1e-16).otherwise(F.lit(0.0))
    prior_std = F.greatest(F.sqrt(F.greatest(F.lit(0.0), F.col("_v0"))), floor)
    z = F.when((F.col("_count") > MIN_PRIOR_ROWS) & (prior_std > 0), F.col("_step") / prior_std)
    return walked.withColumns(
        {
            "baseline_mean": F.col("_m") + F.col("_first"),
            "baseline_std": F.sqrt(F.greatest(F.lit(0.0), F.col("_v"))),
            "sample_count": F.col("_count").cast("int"),
            "z_score": z,
        }
    ).select(*SIGNAL)


def _jump_to_newest(df: DataFrame, groups: list[str]) -> DataFrame:
    """alpha = 1: the mean is the newest value and the spread is always zero."""
    position = F.row_number().over(Window.partitionBy(*groups).orderBy(*ORDER))
    return df.withColumns(
        {
            "baseline_mean": F.col("value"), "baseline_std": F.lit(0.0),
            "sample_count": position, "z_score": F.lit(None).cast("double"),
        }
    )


def _segment_carries(hot: DataFrame, alpha: float) -> DataFrame:
    """State before each segment of a hot key; one row per (key, segment), so it is small."""
    q = 1.0 - alpha
    seg_keys = [*KEYS, "_seg"]
    earlier = Window.partitionBy(*KEYS).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)

    def fold(amount: str) -> Column:
        parts = F.collect_list(F.struct(F.col("_n").alias("n"), F.col(amount).alias("x"))).over(earlier)
        return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * F.pow(F.lit(q), p["n"]) + p["x"])

    shape = hot.groupBy(*seg_keys).agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_from"), F.max("_pos").alias("_to"),
        F.min_by("value", "_pos").alias("_head"),
    )
    opening = Window.partitionBy(*KEYS).orderBy("_seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shape = shape.withColumn("_first", F.first("_head").over(opening)).drop("_head")
    placed = hot.join(F.broadcast(shape), seg_keys).withColumns(
        {
            "_w": F.pow(F.lit(q), F.col("_to") - F.col("_pos")),
            "_y": F.col("value") - F.col("_first"),
        }
    )
    ends = placed.groupBy(*seg_keys, "_n", "_from", "_first").agg(
        F.sum(F.lit(alpha) * F.col("_w") * F.col("_y")).alias("_m_end"),
        F.max(F.abs("_y")).alias("_moved_here"),
    )
    return ends.withColumns(
        {
            "_m_in": fold("_m_end"),
            "_n_in": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
            "_moved_in": F.coalesce(F.max("_moved_here").over(earlier), F.lit(0.0)),
        }
    ).drop("_m_end", "_moved_here")


def _variance_carries(walked: DataFrame, alpha: float) -> DataFrame:
    """Variance before each segment, from the variance each segment adds on its own."""
    q = 1.0 - alpha
    earlier = Window.partitionBy(*KEYS).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    own = walked.groupBy(*KEYS, "_seg").agg(
        F.count("*").alias("n"), F.max_by("_v", "rn").alias("x")
    )
    parts = F.collect_list(F.struct("n", "x")).over(earlier)
    return own.select(
        *KEYS, "_seg",
        F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * F.pow(F.lit(q), p["n"]) + p["x"]).alias("_v_in"),
    )


def _hot_signals(hot: DataFrame, alpha: float) -> DataFrame:
    """Walk every segment once, then add what earlier segments leave of their variance."""
    seg_keys = [*KEYS, "_seg"]
    carries = F.broadcast(_segment_carries(hot, alpha))  # one row per segment
    rows = hot.join(carries, seg_keys).withColumn("rn", F.col("_pos") - F.col("_from") + 1)
    kept = ["t", "value", "edge_id", "rn", "_first", "_m", "_m0", "_step", "_v", "_v0", "_moved", "_count"]
    walked = materialize(_walk(rows, seg_keys, alpha, carry=True).select(*seg_keys, *kept))
    spread = F.broadcast(_variance_carries(walked, alpha))  # one row per segment
    left = lambda age: F.col("_v_in") * F.pow(F.lit(1.0 - alpha), age)
    walked = walked.join(spread, seg_keys).withColumns(
        {"_v": F.col("_v") + left(F.col("rn")), "_v0": F.col("_v0") + left(F.col("rn") - 1)}
    )
    return _signals(walked)


def observations(edges: DataFrame, value: str = "w_0", t: str = "t_e") -> DataFrame:
    return edges.select(
        F.col("src").alias("entity"), "protocol", F.col(t).alias("t"), F.col(value).alias("value"), "edge_id"
    )


def deviation_signals(
    edges: DataFrame, alpha: float = ALPHA, value: str = "w_0", t: str = "t_e",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One signal per edge: z against the state before it, baseline after it.

    ``value`` is the weight to observe; by default each edge is evaluated at its own
    time, where the decayed weight equals w_0.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    rows = observations(edges, value, t)
    if alpha == 1:
        return _jump_to_newest(rows, KEYS).select(*SIGNAL)
    cold, hot = segment_hot(rows, KEYS, ORDER, hot_rows)
    start = Window.partitionBy(*KEYS).orderBy(*ORDER)
    cold = cold.withColumns({"rn": F.row_number().over(start), "_first": F.first("value").over(start)})
    signals = _signals(_walk(cold, KEYS, alpha))
    if hot is not None:
        signals = signals.unionByName(_hot_signals(hot, alpha))
    return signals


def flag_anomalies(signals: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return signals.filter(F.abs("z_score") >= F.lit(float(threshold)))


def baseline_profile(signals: DataFrame) -> DataFrame:
    """Newest mean, variance and count per (entity, protocol)."""
    newest = F.max_by(F.struct("baseline_mean", "baseline_std", "sample_count"), "sample_count")
    return signals.groupBy(*KEYS).agg(newest.alias("s")).select(
        *KEYS,
        F.col("s.baseline_mean").alias("mean"),
        (F.col("s.baseline_std") * F.col("s.baseline_std")).alias("variance"),
        F.col("s.sample_count").alias("sample_count"),
    )


def latest_deviation(signals: DataFrame) -> DataFrame:
    """Newest non-null z per entity over all protocols."""
    return (
        signals.filter(F.col("z_score").isNotNull())
        .groupBy("entity")
        .agg(F.max_by("z_score", F.struct("t", "edge_id")).alias("z_score"))
    )
