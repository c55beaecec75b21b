"""Ordered edge patterns chained by an entity within a time window.

A chain never changes its key, so (motif, chain_key) is the only grouping needed.
Rows of one key are ordered by (t_e, edge_id, stage): at one instant ties follow the
edge id, and an edge opens a chain before it may advance it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbgraph.config import Motif, load_motifs
from ebbgraph.functions.columns import chain_key, step_score
from ebbgraph.operators.scale import HOT_ROWS, fold_by_key, materialize, segment_hot
from ebbgraph.schema import COMPLETION, OPEN_CHAIN, RESET

KEYS = ["motif_name", "chain_key"]
ORDER = ["t_e", "edge_id", "stage"]
MIN_CONFIDENCE = 0.5
PRUNE_ROW = -1  # stage number of a row that says an edge was pruned at t_e

EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("motif_name", T.StringType()),
        T.StructField("chain_key", T.StringType()),
        T.StructField("matched_edges", T.ArrayType(T.StringType())),
        T.StructField("at", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("triggering_edge_id", T.StringType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("started_at", T.DoubleType()),
    ]
)


def motif_candidates(
    edges: DataFrame, motifs: Sequence[Motif] | None = None, fuzzy: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Every step an edge fits: (motif, stage, chain_key, score), and the columns of ``keep``. A projection,
    not a join: each step is an expression and only the fitting ones are exploded."""
    motifs = load_motifs() if motifs is None else motifs
    fits = []
    for motif in motifs:
        for stage, step in enumerate(motif.steps):
            score, key = step_score(step, fuzzy), chain_key(step)
            fit = F.struct(
                F.lit(motif.name).alias("motif_name"),
                key.alias("chain_key"),
                F.lit(stage).alias("stage"),
                F.lit(len(motif.steps)).alias("n_steps"),
                F.lit(motif.window_seconds).alias("window_seconds"),
                score.alias("score"),
            )
            fits.append(F.when(score.isNotNull() & key.isNotNull(), fit))
    return edges.select(
        "edge_id", "t_e", *keep, F.explode(F.array_compact(F.array(*fits))).alias("c")
    ).select("c.*", "edge_id", "t_e", *keep)


# --- two steps: window functions ---------------------------------------------------
#
# An advance row always leaves its key idle (it completes the chain, finds it overrun,
# or fails the confidence test), so the chain live at an advance row was opened by the
# first start row since the previous advance row.


def _start() -> Column:
    return F.when(F.col("stage") == 0, F.struct("t_e", "edge_id", "score"))


def _live_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_epoch`` (advance rows before this one) and ``_live`` (chain open before it)."""
    ordered = Window.partitionBy(*keys).orderBy(*ORDER)
    advances = F.count_if(F.col("stage") == 1).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_epoch": advances, "_opens": _start()})
    epoch = Window.partitionBy(*keys, "_epoch").orderBy(*ORDER)
    return rows.withColumn(
        "_live", F.first("_opens", True).over(epoch.rowsBetween(Window.unboundedPreceding, 0))
    )


def _stitched_starts(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live starts of hot keys, local to each segment plus the chain left open before it,
    and the chain each key leaves open at its end."""
    seg_keys = [*KEYS, "_seg"]
    rows = _live_starts(hot, seg_keys)
    tail = F.max_by("_live", F.struct("_epoch", "_pos"))
    advances = F.count_if(F.col("stage") == 1)
    summary = rows.groupBy(*seg_keys).agg(advances.alias("_advances"), F.max("_epoch").alias("_last_epoch"), tail.alias("_tail"))
    # the newest epoch's start is still open only if no advance row closed it
    summary = summary.withColumn(
        "_tail", F.when(F.col("_last_epoch") == F.col("_advances"), F.col("_tail"))
    )
    ordered = Window.partitionBy(*KEYS).orderBy("_seg")
    summary = summary.withColumn(
        "_run", F.count_if(F.col("_advances") > 0).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    in_run = Window.partitionBy(*KEYS, "_run").orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_open_after", F.first("_tail", True).over(in_run))
    summary = summary.withColumn("_open_before", F.lag("_open_after").over(ordered))
    last = Window.partitionBy(*KEYS).orderBy(F.desc("_seg"))
    summary = summary.withColumn("_final", F.row_number().over(last) == 1)
    carried = F.broadcast(summary.select(*seg_keys, "_open_before"))  # one row per segment
    joined = rows.join(carried, seg_keys)
    return (
        joined.withColumn(
            "_live",
            F.when(F.col("_epoch") == 0, F.coalesce("_open_before", "_live")).otherwise(F.col("_live")),
        ),
        summary.filter("_final").select(*KEYS, F.col("_open_after").alias("_open")),
    )


def _open_after_last(rows: DataFrame) -> DataFrame:
    """Chain left open per key: the start of the newest epoch unless an advance row closed it."""
    newest = F.max_by(F.struct("_live", "stage"), F.struct("_epoch", *ORDER)).alias("_n")
    return (
        rows.groupBy(*KEYS).agg(newest)
        .select(*KEYS, F.when(F.col("_n.stage") == 0, F.col("_n._live")).alias("_open"))
    )


def _two_step(cands: DataFrame, min_confidence: float, hot_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """(completions, open chains) of two-step motifs."""
    cold, hot = segment_hot(cands, KEYS, ORDER, hot_rows)
    rows = _live_starts(cold, KEYS)
    left_open = _open_after_last(rows)
    wanted = [*KEYS, *ORDER, "window_seconds", "score", "_live"]
    rows = rows.select(*wanted)
    if hot is not None:
        stitched, hot_open = _stitched_starts(hot)
        rows = rows.unionByName(stitched.select(*wanted))
        left_open = left_open.unionByName(hot_open)
    confidence = F.col("_live.score") * F.col("score")
    completions = rows.filter(
        (F.col("stage") == 1)
        & (F.col("t_e") - F.col("_live.t_e") <= F.col("window_seconds"))
        & (confidence >= F.lit(float(min_confidence)))
    ).select(
        *KEYS,
        F.array("_live.edge_id", "edge_id").alias("matched_edges"),
        F.col("t_e").alias("completed_at"),
        confidence.alias("confidence"),
    )
    open_chains = left_open.filter(F.col("_open").isNotNull()).select(
        *KEYS, F.lit(1).alias("stage"), F.col("_open.t_e").alias("started_at"),
        F.col("_open.t_e").alias("last_edge_ts"), F.array("_open.edge_id").alias("matched_edges"),
        F.col("_open.score").alias("confidence"),
    )
    return completions, open_chains


# --- any number of steps, time-outs and resets: fold per key --------------------------


class ChainFold:
    """One chain slot per key, advanced row by row.

    State is JSON text: stage, started, last, ids, conf, dies (time-out), killed
    (earliest prune of a matched edge: [time, edge_id]) and used (edge that advanced it last).
    """

    def __init__(self, min_confidence: float, timeout: bool) -> None:
        self.min_confidence = min_confidence
        self.timeout = timeout

    def _lapse(self, state: dict | None, now: float | None) -> tuple[dict | None, dict | None]:
        """Drop a chain whose time-out or prune came before ``now`` (None: end of data)."""
        if state is None:
            return None, None
        dies, killed = state["dies"], state["killed"]
        if killed and (now is None or now > killed[0]) and (dies is None or killed[0] < dies):
            return None, state
        if dies is not None and now is not None and now >= dies:
            return None, None
        return state, None

    def __call__(self, text: str | None, rows: pd.DataFrame) -> tuple[list[tuple], str | None]:
        columns = ("t_e", "edge_id", "stage", "n_steps", "window_seconds", "score", "pruned_at")
        key = tuple(rows[c].iloc[0] for c in KEYS) if len(rows) else (None, None)  # rows of one key
        return self.advance(text, key, zip(*(rows[c].tolist() for c in columns)))

    def advance(self, text: str | None, names: tuple, rows: Iterable[Sequence]) -> tuple[list[tuple], str | None]:
        """Advance the slot of the key ``names`` over rows of (t_e, edge_id, stage, n_steps, window_seconds, score, pruned_at if known)."""
        motif, key = names
        state = json.loads(text) if text else None
        out: list[tuple] = []
        for t, edge, stage, steps, window, score, *rest in rows:
            pruned = rest[0] if rest else None
            state, reset = self._lapse(state, t)
            if reset:
                out.append(self.reset_row(motif, key, reset))
            if stage == PRUNE_ROW:
                if state and edge in state["ids"]:
                    out.append(self.reset_row(motif, key, {**state, "killed": [t, edge]}))
                    state = None
            elif stage == 0:
                if state is None:
                    if steps == 1:
                        if score >= self.min_confidence:
                            out.append(("completion", motif, key, [edge], t, score, None, None, t))
                    else:
                        state = {"stage": 1, "started": t, "ids": [], "conf": 1.0, "killed": None, "used": None}
                        self._extend(state, edge, t, score, pruned, window)
            elif state and state["stage"] == stage and state["used"] != edge and t >= state["last"]:
                if t - state["started"] > window:
                    state = None
                    continue
                self._extend(state, edge, t, score, pruned, window)
                state["stage"], state["used"] = stage + 1, edge
                if stage + 1 == steps:
                    if state["conf"] >= self.min_confidence:
                        out.append(("completion", motif, key, state["ids"], t, state["conf"], None, None, state["started"]))
                    state = None
        return out, json.dumps(state, sort_keys=True) if state else None

    def _extend(self, state: dict, edge: str, t: float, score: float, pruned: float, window: float) -> None:
        state["ids"] = [*state["ids"], edge]
        state["conf"] *= score
        state["last"] = t
        state["dies"] = t + window if self.timeout else None
        if pruned == pruned and pruned is not None:
            kill = [pruned, edge]
            state["killed"] = min(state["killed"] or kill, kill)

    @staticmethod
    def reset_row(motif: str, key: str, state: dict) -> tuple:
        time, edge = state["killed"]
        return ("reset", motif, key, state["ids"], time, state["conf"], edge, state["stage"], state["started"])

    def finish(self, key: tuple, text: str | None) -> list[tuple]:
        if not text:
            return []
        state, reset = self._lapse(json.loads(text), None)
        if reset:
            return [self.reset_row(*key, reset)]
        return [("open", *key, state["ids"], state["last"], state["conf"], None, state["stage"], state["started"])]


def attach_prunes(cands: DataFrame, prunes: DataFrame | None) -> DataFrame:
    """First time each candidate's edge was pruned at or after its own time (null: never)."""
    if prunes is None:
        return cands.withColumn("pruned_at", F.lit(None).cast("double"))
    later = cands.select("edge_id", "t_e").distinct().join(prunes.select("edge_id", "pruned_at"), "edge_id")
    gone = later.filter(F.col("pruned_at") >= F.col("t_e")).groupBy("edge_id", "t_e").agg(F.min("pruned_at").alias("pruned_at"))
    return cands.join(gone, ["edge_id", "t_e"], "left")


def _folded(
    cands: DataFrame, prunes: DataFrame | None, min_confidence: float, timeout: str, hot_rows: int
) -> DataFrame:
    fold = ChainFold(min_confidence, timeout == "event_time")
    return fold_by_key(attach_prunes(cands, prunes), KEYS, ORDER, fold, fold.finish, EVENT, hot_rows)


def _check_timeout(timeout: str) -> None:
    if timeout not in ("none", "event_time"):
        raise ValueError("timeout must be 'none' or 'event_time'")


class MotifResult:
    """Completions, resets and chains left open, as three frames over one plan."""

    def __init__(self, completions: DataFrame, resets: DataFrame, open_chains: DataFrame) -> None:
        self.completions, self.resets, self.open_chains = completions, resets, open_chains


def _named(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def run_motifs(
    edges: DataFrame, motifs: Sequence[Motif] | None = None, *, fuzzy: bool = False,
    min_confidence: float = MIN_CONFIDENCE, timeout: str = "none",
    prunes: DataFrame | None = None, hot_rows: int | None = HOT_ROWS, stored: bool = True,
) -> MotifResult:
    """Match every motif. ``timeout="none"`` keeps a chain until a row of its own decides
    it (a replay); ``"event_time"`` forgets it window_seconds after its last edge.
    ``prunes`` (edge_id, pruned_at) resets chains that used a pruned edge. ``stored``
    writes folded events once, so that the three frames do not each fold again."""
    _check_timeout(timeout)
    motifs = load_motifs() if motifs is None else list(motifs)
    plain = timeout == "none" and prunes is None
    windowed = [m for m in motifs if plain and len(m.steps) == 2]
    folded = [m for m in motifs if m not in windowed]
    spark = edges.sparkSession
    parts: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    no_resets = spark.createDataFrame([], RESET)
    if windowed:
        done, left = _two_step(motif_candidates(edges, windowed, fuzzy), min_confidence, hot_rows)
        parts.append((done, no_resets, left))
    if folded:
        events = _folded(motif_candidates(edges, folded, fuzzy), prunes, min_confidence, timeout, hot_rows)
        if stored:
            events = materialize(events)
        of = lambda kind: events.filter(F.col("kind") == kind)
        parts.append(
            (
                of("completion").withColumnRenamed("at", "completed_at"),
                of("reset").withColumnRenamed("at", "reset_at"),
                of("open").withColumnRenamed("at", "last_edge_ts"),
            )
        )
    if not parts:
        return MotifResult(*[spark.createDataFrame([], s) for s in (COMPLETION, RESET, OPEN_CHAIN)])
    frames = [
        reduce(lambda a, b: a.unionByName(b), [_named(p[i], schema) for p in parts])
        for i, schema in enumerate((COMPLETION, RESET, OPEN_CHAIN))
    ]
    return MotifResult(*frames)


def match_motifs(edges: DataFrame, motifs: Sequence[Motif] | None = None, **options) -> DataFrame:
    """Completed chains: (motif_name, chain_key, matched_edges, completed_at, confidence)."""
    return run_motifs(edges, motifs, stored=False, **options).completions


def motif_resets(edges: DataFrame, prunes: DataFrame, motifs: Sequence[Motif] | None = None, **options) -> DataFrame:
    return run_motifs(edges, motifs, prunes=prunes, stored=False, **options).resets


def open_chains(edges: DataFrame, motifs: Sequence[Motif] | None = None, **options) -> DataFrame:
    return run_motifs(edges, motifs, stored=False, **options).open_chains


def chains_containing(chains: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """Open chains that used any of the given edges, with the edge concerned."""
    used = chains.withColumn("edge_id", F.explode("matched_edges"))
    return used.join(edge_ids.select("edge_id").distinct(), "edge_id", "left_semi")
