"""Keyed stateful streams: deviation scores and motif chains.

Each micro-batch is bounded by the source's trigger limit, and so is what one key can
bring in one call. Rows are ordered inside the micro-batch; between micro-batches they
count in the order they arrive, or, in ``ordered_motifs``, in event order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbgraph.config import Motif
from ebbgraph.operators import baseline
from ebbgraph.operators.motifs import EVENT, KEYS, MIN_CONFIDENCE, PRUNE_ROW, ChainFold, motif_candidates

SIGNAL_LAYOUT = (
    "entity string, protocol string, t double, value double, baseline_mean double, "
    "baseline_std double, sample_count int, z_score double, edge_id string"
)


#: Groups of a stream's state. Spark's call of a group costs milliseconds whatever it holds, so the keys of one hash share a
#: group, each with a state of its own in it. A stream keeps the number it began with.
BUCKETS = 1024


#: Settings under which a stream with state is to start. State lies on the executors' disks, under one bound of memory for each
#: executor; by default two versions of all of it lie in the heap, and it grows with the keys and with the rows that wait.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def _place(t: float, edge: str | None, *more: int) -> tuple:
    """Sort key of event order: time, then edge id, unknown ones last."""
    return t != t, 0.0 if t != t else t, edge is None, edge or "", *more


class BaselineStep:
    """Advance one bucket of (entity, protocol) baselines over the rows of a micro-batch."""

    STATE = "entities array<string>, protocols array<string>, means array<double>, vars array<double>, counts array<bigint>"

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def __call__(self, bucket: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            entities, protocols, *numbers = state.get
            held = dict(zip(zip(entities, protocols), zip(*numbers)))
        rows = []
        for frame in batches:
            rows.extend(zip(*(frame[c].tolist() for c in (*baseline.KEYS, "t", "value", "edge_id"))))
        rows.sort(key=lambda row: _place(row[2], row[4]))
        alpha, out = self.alpha, []
        for entity, protocol, t, value, edge in rows:
            mean, var, n = held.get((entity, protocol), (0.0, 0.0, 0))
            std = var**0.5
            z = (value - mean) / std if n >= baseline.MIN_PRIOR_ROWS and std > 0 else None
            if n == 0:
                mean, var = value, 0.0
            else:
                step = value - mean
                mean += alpha * step
                var = (1 - alpha) * (var + alpha * step * step)
            n += 1
            held[entity, protocol] = mean, var, n
            out.append((entity, protocol, t, value, mean, var**0.5, n, z, edge))
        state.update((*map(list, zip(*held)), *map(list, zip(*held.values()))))
        frame = pd.DataFrame(out, columns=baseline.SIGNAL)
        frame["z_score"] = frame["z_score"].astype("float64")
        yield frame


def stream_deviation(
    edges: DataFrame, alpha: float = baseline.ALPHA, value: str = "w_0", t: str = "t_e", buckets: int = BUCKETS
) -> DataFrame:
    """One signal per arriving edge."""
    return _bucketed(baseline.observations(edges, value, t), baseline.KEYS, buckets).applyInPandasWithState(
        BaselineStep(alpha).__call__, SIGNAL_LAYOUT, BaselineStep.STATE, "append", GroupStateTimeout.NoTimeout
    )


#: What a chain needs of a row.
ROW = ("t_e", "edge_id", "stage", "n_steps", "window_seconds", "score")


def _event_order(row: Sequence) -> tuple:
    """Sort key of a ``ROW``; at one instant edges come before prunes."""
    late, t, *edge = _place(row[0], row[1], row[2])
    return late, t, row[2] == PRUNE_ROW, *edge


def _packed(rows: Iterable[Sequence]) -> list[Sequence]:
    """Rows with the edges pruned at one instant as one row, with a list of ids: a pass prunes them by the million, and so they wait."""
    kept, pruned = [], {}
    for row in rows:
        if row[2] != PRUNE_ROW:
            kept.append(row)
        elif isinstance(row[1], list):
            pruned.setdefault(row[0], []).extend(row[1])
        else:
            pruned.setdefault(row[0], []).append(row[1])
    return kept + [(t, ids, PRUNE_ROW, None, None, None) for t, ids in pruned.items()]


def _in_order(rows: Iterable[Sequence]) -> Iterator[Sequence]:
    """Rows in event order, pruned edges one by one."""
    for row in sorted(_packed(rows), key=_event_order):
        if row[2] == PRUNE_ROW:
            for edge in sorted(row[1], key=lambda e: (e is None, e or "")):
                yield row[0], edge, *row[2:]
        else:
            yield row


class ChainSlots:
    """Run a step for every (motif, chain_key) slot of a bucket that has rows or whose timer is due.

    The bucket's timer is its earliest slot's. ``step.advance(key, rows, value, passed)`` takes a slot's value
    (None: new), its rows (None: the timer is due) and the watermark, and returns events, value and timer.
    """

    STATE = "motifs array<string>, chain_keys array<string>, chains array<string>, waiting array<string>, wakes array<bigint>"

    def __init__(self, step: ChainStep | OrderedChainStep, timed: bool) -> None:
        self.step, self.timed = step, timed

    def __call__(self, bucket: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, arrived, pruned, out = {}, {}, {}, []
        if state.exists:
            motifs, keys, chains, waiting, wakes = state.get
            slots = dict(zip(zip(motifs, keys), zip(zip(chains, waiting), wakes)))
        passed = state.getCurrentWatermarkMs() if self.timed else 0
        if not state.hasTimedOut:
            for frame in batches:
                names = zip(*(frame[c].tolist() for c in KEYS))
                for key, row in zip(names, zip(*(frame[c].tolist() for c in ROW))):
                    if row[2] == PRUNE_ROW:
                        pruned.setdefault(key, {}).setdefault(row[0], []).append(row[1])
                    else:
                        arrived.setdefault(key, []).append(row)
        for key, at in pruned.items():
            arrived.setdefault(key, []).extend((t, ids, PRUNE_ROW, None, None, None) for t, ids in at.items())
        due = [key for key, (_, wake) in slots.items() if wake is not None and wake < passed and key not in arrived]
        for key in (*arrived, *due):
            found, value, wake = self.step.advance(key, arrived.get(key), slots.pop(key, (None, None))[0], passed)
            out += found
            if value is not None:
                slots[key] = value, wake
        if slots:
            held = [(*key, *value, wake) for key, (value, wake) in slots.items()]
            state.update(tuple(map(list, zip(*held))))
            wakes = [row[-1] for row in held if row[-1] is not None]
            if wakes:
                state.setTimeoutTimestamp(max(min(wakes), passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=EVENT.fieldNames())


class ChainStep:
    """Advance one (motif, chain_key) slot over the rows of a micro-batch."""

    def __init__(self, fold: ChainFold) -> None:
        self.fold = fold

    def advance(self, key: tuple, rows: list | None, value: tuple | None, passed: int) -> tuple[list, tuple | None, int | None]:
        if rows is None:
            return [], None, None
        out, text = self.fold.advance(value[0] if value else None, key, _in_order(rows))
        if not text:
            return out, None, None
        dies = json.loads(text)["dies"]
        return out, (text, None), None if dies is None else max(int(dies * 1000), passed + 1)


def _prune_rows(pruned: DataFrame, motifs: Sequence[Motif] | None, fuzzy: bool, keep: Sequence[str] = ()) -> DataFrame:
    """Rows that tell chains of their pruned edges. An edge that fits a last step ends its chain, so no chain is left that holds it."""
    routed = motif_candidates(pruned, motifs, fuzzy, keep).filter(F.col("stage") < F.col("n_steps") - 1)
    return routed.withColumn("stage", F.lit(PRUNE_ROW))


def stream_motifs(
    edges: DataFrame, motifs: Sequence[Motif] | None = None, *, fuzzy: bool = False,
    min_confidence: float = MIN_CONFIDENCE, timeout: str = "none", lateness: str = "1 hour",
    pruned: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Completion and reset events of an edge stream (columns as in ``motifs.EVENT``).

    ``pruned`` is a stream of pruned edges; a chain that used one is reset. With
    ``timeout="event_time"`` chains are forgotten window_seconds after their last edge and
    edges later than the watermark are left out.
    """
    rows = motif_candidates(edges, motifs, fuzzy)
    if pruned is not None:
        rows = rows.unionByName(_prune_rows(pruned.withColumn("t_e", F.col("pruned_at")), motifs, fuzzy))
    rows = rows.withColumn("pruned_at", F.lit(None).cast("double"))
    limit = GroupStateTimeout.NoTimeout
    if timeout == "event_time":
        rows = rows.withColumn("event_time", F.timestamp_micros((F.col("t_e") * 1e6).cast("long")))
        rows = rows.withWatermark("event_time", lateness)
        limit = GroupStateTimeout.EventTimeTimeout
    timed = timeout == "event_time"
    slots = ChainSlots(ChainStep(ChainFold(min_confidence, timed)), timed)
    return _bucketed(rows, KEYS, buckets).applyInPandasWithState(slots.__call__, EVENT, ChainSlots.STATE, "append", limit)


class OrderedChainStep:
    """Advance one (motif, chain_key) slot in event order.

    Rows wait in the key's state until the watermark has passed them: by then none before them can
    still arrive, so they are released in order. A key's wait list holds what came within the
    lateness, no more. A timer wakes the key for its earliest waiting row, else for its time-out.
    """

    ROW = ROW

    def __init__(self, fold: ChainFold) -> None:
        self.fold = fold

    def __call__(self, key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The step of a group that is one slot."""
        rows = None
        if not state.hasTimedOut:
            rows = [row for frame in batches for row in zip(*(frame[c].tolist() for c in self.ROW))]
        out, value, wake = self.advance(key, rows, state.get if state.exists else None, state.getCurrentWatermarkMs())
        if value is not None:
            state.update(value)
            if wake is not None:
                state.setTimeoutTimestamp(wake)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=EVENT.fieldNames())

    def advance(self, key: tuple, rows: list | None, value: tuple | None, passed: int) -> tuple[list, tuple | None, int | None]:
        chain, text = value or (None, "[]")
        out, due, later = [], [], []
        for row in (*json.loads(text), *(rows or ())):
            (due if clock_ms(row[0]) <= passed else later).append(row)
        if due:
            out, chain = self.fold.advance(chain, key, _in_order(due))
        dies = json.loads(chain)["dies"] if chain else None
        if not later and dies is not None and clock_ms(dies) <= passed:
            chain = None  # no row that could still use it can arrive
        if not later and not chain:
            return out, None, None
        wake = min(row[0] for row in later) if later else dies
        # fires once the watermark reaches it
        return out, (chain, json.dumps(_packed(later))), None if wake is None else max(clock_ms(wake) - 1, passed + 1)


def clock_ms(t: float) -> int:
    """The stream clock counts half milliseconds, so that a timer can be set just before any instant.

    It is one millisecond ahead: a stream's watermark begins at 0, and an edge at time 0 is not late. No
    edge may lie before the epoch.
    """
    return 2 * math.floor(t * 1000) + 2


def _clocked(frame: DataFrame, t: str, lateness: float) -> DataFrame:
    """With ``_clock``, the time column of the watermark, which trails the newest row by ``lateness`` seconds."""
    timed = frame.withColumn("_clock", F.timestamp_millis(2 * F.floor(F.col(t) * 1000) + 2))
    return timed.withWatermark("_clock", f"{2 * round(lateness * 1000)} milliseconds")


def ordered_motifs(
    edges: DataFrame, motifs: Sequence[Motif] | None = None, *, fuzzy: bool = False, min_confidence: float = MIN_CONFIDENCE,
    timeout: str = "none", lateness: float = 0.0, pruned: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Completion and reset events of edges that arrive in any order within ``lateness`` seconds.

    Equal to the batch match of the edges that are not late. Edges at or before the watermark of earlier
    micro-batches are late and left out; the newest ``lateness`` seconds wait for newer edges. ``pruned``
    is a second stream, of pruned edges (with ``pruned_at``): both streams' rows meet in one state in
    order of time, edges before prunes at one instant, and the slower stream holds the watermark back. A
    row of it without an edge_id only moves its time on.
    """
    rows = motif_candidates(_clocked(edges, "t_e", lateness), motifs, fuzzy, keep=["_clock"])
    if pruned is not None:
        timed = _clocked(pruned.withColumn("t_e", F.col("pruned_at")), "pruned_at", lateness)
        rows = rows.unionByName(_prune_rows(timed, motifs, fuzzy, ["_clock"]))
    slots = ChainSlots(OrderedChainStep(ChainFold(min_confidence, timeout == "event_time")), True)
    return _bucketed(rows, KEYS, buckets).applyInPandasWithState(
        slots.__call__, EVENT, ChainSlots.STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def completions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "completion").select(
        "motif_name", "chain_key", "matched_edges", F.col("at").alias("completed_at"), "confidence"
    )


def resets(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "reset").select(
        "motif_name", "chain_key", "triggering_edge_id", "matched_edges", F.col("at").alias("reset_at")
    )
