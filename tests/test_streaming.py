import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig, load_motifs
from ebbgraph.operators import baseline, calibration, decay, graph, motifs as M
from ebbgraph.plans import queries
from ebbgraph.schema import EDGE
from ebbgraph.sources.tables import replay_stream, write_replay
from ebbgraph.streaming import batches, continuous, keyed
from helpers import edges, random_edges
from test_motifs import AB, admin, hop


def staged(df, folder, files=4):
    """Edges in time order over several files, oldest file first."""
    folder.mkdir()
    rows = [r.asDict() for r in df.orderBy("t_e", "edge_id").collect()]
    size = -(-len(rows) // files)
    for i in range(files):
        (folder / f"part-{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i * size : (i + 1) * size]))
        time.sleep(0.05)
    return str(folder)


def drain(frame, schema, tmp_path, name="out"):
    writer = frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    writer.trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    return frame.sparkSession.read.schema(schema).parquet(str(tmp_path / name))


def drain_batches(frame, sink, tmp_path, name):
    writer = frame.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    writer.trigger(availableNow=True).start().awaitTermination()


def test_deviation_stream_equals_batch(spark, tmp_path):
    df = random_edges(spark, 300)
    stream = keyed.stream_deviation(replay_stream(spark, staged(df, tmp_path / "in")))
    got = {r.edge_id: r for r in drain(stream, keyed.SIGNAL_LAYOUT, tmp_path).collect()}
    expected = {r.edge_id: r for r in baseline.deviation_signals(df).collect()}
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key].sample_count == row.sample_count
        assert (got[key].z_score is None) == (row.z_score is None)
        assert (got[key].z_score or 0) == pytest.approx(row.z_score or 0, rel=1e-8, abs=1e-9)


@pytest.mark.parametrize("timeout", ["none", "event_time"])
def test_motif_stream_equals_batch(spark, tmp_path, timeout):
    df = random_edges(spark, 400)
    stream = keyed.stream_motifs(replay_stream(spark, staged(df, tmp_path / "in")), timeout=timeout)
    got = keyed.completions(drain(stream, M.EVENT, tmp_path))
    rows = lambda d: sorted((r.motif_name, r.chain_key, tuple(r.matched_edges), r.completed_at) for r in d.collect())
    expected = rows(M.match_motifs(df, timeout=timeout))
    assert rows(got) == expected and len(expected) > 10


def test_prune_stream_resets_chain(spark, tmp_path):
    df = edges(spark, [hop(0), hop(10, "A", "Z"), admin(60), admin(70, "Z", "Q")])
    path = staged(df, tmp_path / "in", files=2)
    first = df.filter("t_e = 0")
    gone = first.withColumn("pruned_at", F.lit(5.0)).first().asDict()
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone" / "g.json").write_text(json.dumps(gone))
    layout = first.withColumn("pruned_at", F.lit(5.0)).schema
    pruned = spark.readStream.schema(layout).json(str(tmp_path / "gone"))
    events = drain(keyed.stream_motifs(replay_stream(spark, path), AB, pruned=pruned), M.EVENT, tmp_path)
    assert [(r.chain_key, r.triggering_edge_id, r.reset_at) for r in keyed.resets(events).collect()] == [("Machine:B", gone["edge_id"], 5.0)]
    assert [r.chain_key for r in keyed.completions(events).collect()] == ["Machine:Z"]


def test_prune_sink(spark, tmp_path):
    df = random_edges(spark, 160)
    config = DecayConfig(rates={p: 0.0005 for p in ("RDP", "SMB", "Kerberos", "DNS")})
    sink = batches.PruneSink(str(tmp_path / "graph"), decay.PrunePolicy(0.2, 0.9, max_edges=60), lambda s: config, keep=2)
    path = staged(df, tmp_path / "in")
    drain_batches(replay_stream(spark, path), sink, tmp_path, "p")
    passes = sink.passes(spark).orderBy("t").collect()
    assert len(passes) == 4 and [p.scanned for p in passes][0] == 40
    for before, after in zip(passes, passes[1:]):
        assert after.scanned == before.scanned - before.pruned + 40
    live, cold = sink.live(spark, 3), sink.cold(spark)
    assert live.count() == passes[-1].scanned - passes[-1].pruned
    ids = lambda d: {r.edge_id for r in d.select("edge_id").collect()}
    assert ids(live) | ids(cold) == ids(df) and not ids(live) & ids(cold)
    count = cold.count()
    # a batch that runs again writes the same result again
    sink(sink.live(spark, 2).limit(0), 3)
    assert sink.cold(spark).count() <= count
    assert not (tmp_path / "graph" / "live" / "v=0").exists()


@pytest.mark.parametrize("raises", [False, True])
def test_cold_writer_failures_stay_live(spark, tmp_path, raises):
    df = random_edges(spark, 40)
    stored = []

    def writer(cold, path):
        if raises:
            raise OSError("no space")
        cold.filter("t_e % 2 >= 1").write.mode("overwrite").parquet(path)
        stored.append(path)
        return cold.filter("t_e % 2 < 1")

    sink = batches.PruneSink(str(tmp_path / "graph"), decay.PrunePolicy(1.0, 1.0), writer=writer)
    sink(df, 0)
    reading = sink.passes(spark).first()
    due = decay.mark_prunable(df, df.agg(F.max("t_e")).first()[0], decay.PrunePolicy(1.0, 1.0)).filter("prune")
    lost = due.count() if raises else due.filter("t_e % 2 < 1").count()
    assert reading.write_failures == lost > 0 and reading.pruned == due.count() - lost
    assert sink.live(spark, 0).count() == df.count() - reading.pruned


def test_recalibration_stream_equals_batch(spark, tmp_path):
    df = random_edges(spark, 500, seed=4)
    options = {"min_samples": 10, "window_gaps": 50, "tick_edges": 20}
    sink = batches.RecalibrationSink(str(tmp_path / "r"), **options)
    drain_batches(replay_stream(spark, staged(df, tmp_path / "in")), sink, tmp_path, "q")
    rows = lambda d: [tuple(r) for r in d.orderBy("protocol", "t").collect()]
    expected = rows(calibration.adaptive_recalibration(df, **options))
    got = rows(sink.events(spark))
    assert len(got) == len(expected) > 20
    for a, b in zip(got, expected):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-12)


def shuffled(spark, df, folder, delay, last=None):
    """Edges dealt to micro-batches by time plus a delay of up to ``delay`` seconds; then one far later edge that fits nothing."""
    folder.mkdir()
    rows = [r.asDict() for r in df.collect()]
    rows.sort(key=lambda r: r["t_e"] + int(r["edge_id"][:6], 16) % 1000 / 1000 * delay)
    size = -(-len(rows) // 4)
    far = {**rows[0], "src": "User:none", "dst": "User:none", "edge_type": "None", "t_e": max(r["t_e"] for r in rows) + 10 * delay, "edge_id": "far"}
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[far]]
    for i, part in enumerate(parts):
        (folder / f"part-{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        time.sleep(0.05)
    return replay_stream(spark, str(folder)), parts


def events_of(df):
    return sorted((r.motif_name, r.chain_key, tuple(r.matched_edges), r.completed_at) for r in df.collect())


@pytest.mark.parametrize("timeout", ["none", "event_time"])
def test_edges_out_of_order_match_as_in_batch(spark, tmp_path, timeout):
    df = random_edges(spark, 400)
    span = df.agg(F.max("t_e") - F.min("t_e")).first()[0]
    stream, parts = shuffled(spark, df, tmp_path / "in", span / 2)
    assert min(r["t_e"] for r in parts[1]) < max(r["t_e"] for r in parts[0])
    got = keyed.completions(drain(keyed.ordered_motifs(stream, timeout=timeout, lateness=span / 2), M.EVENT, tmp_path))
    expected = events_of(M.match_motifs(df, timeout=timeout))
    assert events_of(got) == expected and len(expected) > 10


def test_late_edges_are_left_out(spark, tmp_path):
    df = random_edges(spark, 400)
    span, lateness = df.agg(F.max("t_e") - F.min("t_e")).first()[0], 50.0
    stream, parts = shuffled(spark, df, tmp_path / "in", span / 2)
    newest, kept = [], []
    for k, part in enumerate(parts[:4]):
        passed = max((keyed.clock_ms(t) for t in newest[: max(0, k - 1)]), default=0) - 2000 * lateness if k > 1 else 0
        kept += [r["edge_id"] for r in part if keyed.clock_ms(r["t_e"]) > passed]
        newest.append(max(r["t_e"] for r in part))
    assert 0 < len(kept) < df.count()
    got = keyed.completions(drain(keyed.ordered_motifs(stream, lateness=lateness), M.EVENT, tmp_path))
    assert events_of(got) == events_of(M.match_motifs(df.filter(F.col("edge_id").isin(kept))))


class State:
    """What the fold needs of a group's state."""

    def __init__(self, watermark):
        self.watermark, self.value, self.wakes, self.hasTimedOut = watermark, None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.wakes = at


def test_waiting_rows_and_time_outs_of_one_key():
    step, key = keyed.OrderedChainStep(M.ChainFold(0.5, True)), ("m", "k")
    frame = lambda *rows: pd.DataFrame([(t, e, s, 2, 100.0, 1.0) for t, e, s in rows], columns=step.ROW)
    state = State(0)
    assert list(step(key, iter([frame((30.0, "b", 1)), frame((10.0, "a", 0))]), state)) == []
    assert state.wakes == keyed.clock_ms(10.0) - 1 and len(json.loads(state.value[1])) == 2
    state.watermark, state.hasTimedOut = keyed.clock_ms(10.0), True
    assert list(step(key, iter([]), state)) == [] and json.loads(state.value[0])["ids"] == ["a"]
    state.watermark = keyed.clock_ms(30.0)
    (out,) = step(key, iter([]), state)
    assert out.iloc[0]["matched_edges"] == ["a", "b"] and state.value is None
    state.hasTimedOut = False
    list(step(key, iter([frame((40.0, "c", 0))]), state))
    state.watermark, state.hasTimedOut = keyed.clock_ms(50.0), True
    list(step(key, iter([]), state))
    assert state.wakes == keyed.clock_ms(140.0) - 1  # the chain's time-out
    state.watermark = keyed.clock_ms(140.0)
    assert list(step(key, iter([]), state)) == [] and state.value is None


def test_prunes_take_their_place_in_time(spark, tmp_path):
    """A prune that arrives before later edges, and one at the instant of the edge that completes the chain."""
    df = edges(spark, [hop(0), hop(10, "A", "Z"), hop(20, "A", "Y"), admin(60), admin(70, "Z", "Q"), admin(80, "Y", "Q")])
    ids = {r.t_e: r for r in df.collect()}
    (tmp_path / "prunes").mkdir()
    pruned = [{**ids[0.0].asDict(), "pruned_at": 30.0}, {**ids[10.0].asDict(), "pruned_at": 70.0}, {"pruned_at": 500.0}]
    (tmp_path / "prunes" / "g.json").write_text("\n".join(json.dumps(r) for r in pruned))
    source = spark.readStream.schema(batches.PRUNE_EVENT).json(str(tmp_path / "prunes"))
    events = drain(keyed.ordered_motifs(replay_stream(spark, staged(df, tmp_path / "in", files=3)), AB, pruned=source), M.EVENT, tmp_path)
    assert [(r.chain_key, r.triggering_edge_id, r.reset_at) for r in keyed.resets(events).collect()] == [("Machine:B", ids[0.0].edge_id, 30.0)]
    assert sorted(r.chain_key for r in keyed.completions(events).collect()) == ["Machine:Y", "Machine:Z"]


def test_pass_sink_publishes_prunes(spark, tmp_path):
    df = random_edges(spark, 60)
    sink = batches.PruneSink(str(tmp_path / "graph"), decay.PrunePolicy(0.4, 0.4))
    sink(df, 0)
    sink(df, 0)  # a pass that runs again replaces its prunes
    seen = drain(sink.prune_stream(spark), batches.PRUNE_EVENT, tmp_path).collect()
    now = df.agg(F.max("t_e")).first()[0]
    gone = {r.edge_id for r in sink.cold(spark).collect()}
    assert {r.edge_id for r in seen} == gone | {None} and len(seen) == len(gone) + 1 and {r.pruned_at for r in seen} == {now}


def test_continuous_run(spark, tmp_path):
    df = random_edges(spark, 200)
    path = staged(df, tmp_path / "in", files=2)
    run = continuous.ContinuousRun(str(tmp_path / "run"), decay.PrunePolicy(0.2, 0.2), load_motifs(), adaptive=True)
    for query in run.start(spark, lambda: replay_stream(spark, path)):
        query.awaitTermination()
    assert run.signals(spark).count() == df.count()
    found = run.motif_events(spark)
    sink = run.prune_sink()
    pruned = sink.cold(spark).select("edge_id", "pruned_at")
    assert events_of(keyed.completions(found)) == events_of(M.match_motifs(df, prunes=pruned))
    resets = lambda d: sorted((r.chain_key, r.triggering_edge_id, r.reset_at) for r in d.collect())
    assert resets(keyed.resets(found)) == resets(M.motif_resets(df, pruned))
    audit = {r.type: r["count"] for r in run.audit(spark).groupBy("type").count().collect()}
    assert audit == {k: n for k, n in (("prune", pruned.count()), ("motif_reset", keyed.resets(found).count())) if n}
    z = baseline.latest_deviation(run.signals(spark))
    want = graph.score_alert_neighborhoods(keyed.completions(found), sink.live(spark, 1), z)
    scores_of = lambda d: {(r.motif_name, r.chain_key, r.entity_id, round(r.score, 9)) for r in d.collect()}
    assert scores_of(run.alert_scores(spark)) == scores_of(want) and want.count()
    now = df.agg(F.max("t_e")).first()[0]
    snap = run.snapshot(spark, now).first()
    assert snap.active_graph_size == decay.active_at(df, now, 0.2).count()
    assert snap.epsilon == pytest.approx(0.2)
    scores = spark.read.parquet(run.folder("scores"))
    assert {r.trigger for r in scores.select("trigger").distinct().collect()} == {"scheduled"}
    assert spark.read.schema(EDGE).parquet(run.folder("graph/live/v=1")).count() > 0


def test_slots_of_one_bucket_keep_their_own_state_and_timers():
    slots = keyed.ChainSlots(keyed.OrderedChainStep(M.ChainFold(0.5, True)), True)
    columns = [*M.KEYS, *keyed.ROW]
    frame = lambda *rows: pd.DataFrame([("m", k, t, e, s, 2, 100.0, 1.0) for k, t, e, s in rows], columns=columns)
    state = State(0)
    assert list(slots((7,), iter([frame(("k", 30.0, "b", 1), ("l", 20.0, "c", 0)), frame(("k", 10.0, "a", 0))]), state)) == []
    assert state.wakes == keyed.clock_ms(10.0) - 1 and sorted(state.value[1]) == ["k", "l"]
    state.watermark = keyed.clock_ms(30.0)
    # a call for the rows of another slot wakes the due ones too
    (out,) = slots((7,), iter([frame(("n", 40.0, "d", 0))]), state)
    assert out[["chain_key", "matched_edges"]].values.tolist() == [["k", ["a", "b"]]]
    assert sorted(state.value[1]) == ["l", "n"] and state.wakes == keyed.clock_ms(40.0) - 1
    state.watermark, state.hasTimedOut = keyed.clock_ms(120.0), True
    assert list(slots((7,), iter([]), state)) == []
    assert state.value[1] == ["n"] and state.wakes == keyed.clock_ms(140.0) - 1
    state.watermark = keyed.clock_ms(140.0)
    assert list(slots((7,), iter([]), state)) == [] and state.value is None


def test_streams_hold_many_keys_in_few_groups(spark, tmp_path):
    df = random_edges(spark, 200)
    path = staged(df, tmp_path / "in")
    signals = drain(keyed.stream_deviation(replay_stream(spark, path), buckets=2), keyed.SIGNAL_LAYOUT, tmp_path, "signals")
    rows = lambda d: {r.edge_id: (r.sample_count, round(r.baseline_mean, 9)) for r in d.collect()}
    assert rows(signals) == rows(baseline.deviation_signals(df))
    found = drain(keyed.stream_motifs(replay_stream(spark, path), timeout="event_time", buckets=2), M.EVENT, tmp_path, "motifs")
    assert events_of(keyed.completions(found)) == events_of(M.match_motifs(df, timeout="event_time"))


def test_a_dealt_table_is_written_once_for_all_its_streams(spark, tmp_path, monkeypatch):
    table, made = spark.range(8).withColumn("b", F.col("id") % 2), []
    monkeypatch.setattr(queries.scale, "scratch_path", lambda s: made.append(s) or str(tmp_path / f"dealt-{len(made)}"))
    opened = queries.dealt_streams(spark, table, F.col("b"), 2)
    assert [drain(opened(), table.schema, tmp_path, f"out-{k}").count() for k in range(2)] == [8, 8] and len(made) == 1


def test_a_replay_of_many_small_batches_is_told_whole(spark, tmp_path):
    """More micro-batches than a stream reports by default, and few folders to list."""
    df = random_edges(spark, 130)
    n = df.count()
    assert n > 100
    write_replay(df, str(tmp_path / "in"), 1)
    folders = list((tmp_path / "in").glob("*=*"))
    assert len(folders) <= 4 and sum(len(list(folder.glob("part-*"))) for folder in folders) == n
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name, None)
    seen = queries.observed_batches(replay_stream(spark, str(tmp_path / "in")), F.count("*"), F.min("t_e"), F.max("edge_id"))
    order = [(r.t_e, r.edge_id) for r in df.orderBy("t_e", "edge_id").select("t_e", "edge_id").collect()]
    assert seen == [(k, 1, *row) for k, row in enumerate(order)]
    assert spark.conf.get(name, None) == before


def test_state_lies_on_disk_and_prunes_wait_packed(spark, tmp_path, monkeypatch):
    """Streams with state start under the disk store; only edges that a chain can hold are routed, all of an instant as one waiting row."""
    df = edges(spark, [hop(0), hop(10, "A", "Z"), admin(60)])
    gone = [r.asDict() | {"pruned_at": 30.0} for r in df.collect()]
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone" / "g.json").write_text("\n".join(json.dumps(r) for r in gone))
    pruned = spark.read.schema(batches.PRUNE_EVENT).json(str(tmp_path / "gone"))
    routed = keyed._prune_rows(pruned.withColumn("t_e", F.col("pruned_at")), AB, False).collect()
    first = [r["edge_id"] for r in gone if r["t_e"] < 60]
    assert sorted(r.edge_id for r in routed) == sorted(first) and {r.stage for r in routed} == {M.PRUNE_ROW}

    slots = keyed.ChainSlots(keyed.OrderedChainStep(M.ChainFold(0.5, False)), True)
    frame = lambda *rows: pd.DataFrame([("m", "k", t, e, s, 2, 100.0, 1.0) for t, e, s in rows], columns=[*M.KEYS, *keyed.ROW])
    state = State(0)
    first, more = frame((50.0, "b", M.PRUNE_ROW), (10.0, "a", 0)), frame((50.0, "a", M.PRUNE_ROW), (40.0, "z", 0))
    assert list(slots((7,), iter([first, more]), state)) == []
    assert sorted(len(json.loads(text)) for text in state.value[3]) == [3]
    assert list(slots((7,), iter([frame((50.0, "c", M.PRUNE_ROW))]), state)) == []
    assert sorted(len(json.loads(text)) for text in state.value[3]) == [3]
    state.watermark, state.hasTimedOut = keyed.clock_ms(50.0), True
    (out,) = slots((7,), iter([]), state)
    assert out[["kind", "triggering_edge_id", "at"]].values.tolist() == [["reset", "a", 50.0]] and state.value is None

    name, seen = "spark.sql.streaming.stateStore.providerClass", []
    start = type(df.sparkSession.readStream.schema(EDGE).json(str(tmp_path / "gone")).writeStream).start
    monkeypatch.setattr(
        "pyspark.sql.streaming.DataStreamWriter.start", lambda self, *a, **b: seen.append(spark.conf.get(name, "")) or start(self, *a, **b)
    )
    run = continuous.ContinuousRun(str(tmp_path / "run"), decay.PrunePolicy(0.2, 0.2))
    path = staged(random_edges(spark, 40), tmp_path / "in", files=1)
    for query in run.start(spark, lambda: replay_stream(spark, path)):
        query.awaitTermination()
    queries.run_stream(keyed.stream_deviation(replay_stream(spark, path)), keyed.SIGNAL_LAYOUT)
    assert len(seen) == 4 and all(kind.endswith(".RocksDBStateStoreProvider") for kind in seen)
    assert not spark.conf.get(name, "").endswith(".RocksDBStateStoreProvider")
