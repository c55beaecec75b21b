import random

import pytest
from pyspark.sql import functions as F

from ebbgraph.config import load_motifs
from ebbgraph.functions import columns as C
from ebbgraph.operators import motifs as M
from ebbgraph.plans.queries import THREE_STEP
from helpers import edges, random_edges, walk_chains

AB = load_motifs(
    {"ab": {"window_seconds": 100, "steps": [
        {"edge_type": "Authentication", "src_type": "Machine", "dst_type": "Machine", "key_field": "dst"},
        {"edge_type": ["Authentication", "RemoteCodeExecution"], "src_type": "User", "dst_type": "Machine",
         "key_field": "src", "key_resolver": "host_admin"}]}}
)


def hop(t, src="A", dst="B"):
    return (f"Machine:{src}", f"Machine:{dst}", "Authentication", "Kerberos", float(t), 1.0)


def admin(t, host="B", dst="C"):
    return (f"User:{host}-admin", f"Machine:{dst}", "RemoteCodeExecution", "RDP", float(t), 1.0)


def run(spark, rows, motifs=AB, **options):
    return M.run_motifs(edges(spark, rows), motifs, **options)


def test_host_admin_key(spark):
    df = spark.createDataFrame([("User:C1042-admin",), ("User:C1042$",), ("User:",), ("User",), ("User:-x",)], "id string")
    keys = [r[0] for r in df.select(C.host_admin_key(F.col("id"))).collect()]
    assert keys == ["Machine:C1042", "Machine:C1042", None, None, None]


def test_match_score(spark):
    motif = load_motifs({"m": {"window_seconds": 1, "steps": [
        {"edge_type": "Authentication", "protocol": "RDP", "src_type": "User", "key_field": "src"},
        {"src_type": "User", "key_field": "src"}]}})[0]
    df = edges(spark, [
        ("User:a", "Machine:b", "Authentication", "RDP", 0.0, 1.0),
        ("User:a", "Machine:b", "Authentication", "SMB", 1.0, 1.0),
        ("User:a", "Machine:b", "FileTransfer", "SMB", 2.0, 1.0),
        ("Machine:a", "Machine:b", "Authentication", "RDP", 3.0, 1.0),
    ])
    rows = df.orderBy("t_e").select(C.match_score(motif.steps[0]), C.match_score(motif.steps[1])).collect()
    assert [tuple(r) for r in rows] == [(1.0, 1.0), (0.5, 1.0), (None, 1.0), (None, None)]


@pytest.mark.parametrize("options", [{}, {"timeout": "event_time"}])
def test_completes(spark, options):
    rows = run(spark, [hop(0), admin(50)], **options).completions.collect()
    assert [(r.chain_key, len(r.matched_edges), r.completed_at, r.confidence) for r in rows] == [("Machine:B", 2, 50.0, 1.0)]


def test_first_start_is_kept(spark):
    df = edges(spark, [hop(0), hop(1, "X"), admin(50)])
    first = df.filter("t_e = 0").first().edge_id
    assert M.match_motifs(df, AB).first().matched_edges[0] == first


def test_advance_before_start_does_nothing(spark):
    result = run(spark, [admin(10), hop(100)])
    assert result.completions.count() == 0
    assert [(r.chain_key, r.stage, r.started_at) for r in result.open_chains.collect()] == [("Machine:B", 1, 100.0)]


def test_window_is_inclusive_and_overrun_drops(spark):
    assert run(spark, [hop(0), admin(100)]).completions.count() == 1
    late = run(spark, [hop(0), admin(100.5)])
    assert late.completions.count() == 0 and late.open_chains.count() == 0


def test_seed_motif(spark):
    rows = [hop(0, "C1001", "C1042"), admin(3600, "C1042", "C2000")]
    done = M.match_motifs(edges(spark, rows)).collect()
    assert [(r.motif_name, r.chain_key) for r in done] == [("lateral_pivot", "Machine:C1042")]


def test_timeout_forgets(spark):
    rows = [hop(0), hop(200, "X"), admin(250)]
    stale = run(spark, rows)
    assert stale.completions.count() == 0
    fresh = run(spark, rows, timeout="event_time")
    assert [r.completed_at for r in fresh.completions.collect()] == [250.0]


def test_prune_resets(spark):
    df = edges(spark, [hop(0), admin(50)])
    first = df.filter("t_e = 0").first().edge_id
    prunes = spark.createDataFrame([(first, 5.0)], "edge_id string, pruned_at double")
    result = M.run_motifs(df, AB, prunes=prunes)
    assert result.completions.count() == 0
    reset = result.resets.collect()
    assert [(r.chain_key, r.triggering_edge_id, r.matched_edges, r.reset_at) for r in reset] == [("Machine:B", first, [first], 5.0)]
    # a prune at the completing edge's own time comes after it
    prunes = spark.createDataFrame([(first, 50.0)], "edge_id string, pruned_at double")
    assert M.match_motifs(df, AB, prunes=prunes).count() == 1


@pytest.mark.parametrize("floor, expected", [(0.5, [0.5]), (0.75, [])])
def test_fuzzy(spark, floor, expected):
    motif = load_motifs({"m": {"window_seconds": 100, "steps": [
        {"edge_type": "Authentication", "src_type": "Machine", "dst_type": "Machine", "key_field": "dst"},
        {"edge_type": "RemoteCodeExecution", "protocol": "SMB", "src_type": "User", "key_field": "src", "key_resolver": "host_admin"}]}})
    rows = run(spark, [hop(0), admin(50)], motif, fuzzy=True, min_confidence=floor).completions.collect()
    assert [r.confidence for r in rows] == expected
    assert run(spark, [hop(0), admin(50)], motif).completions.count() == 0


def test_single_step(spark):
    motif = load_motifs({"s": {"window_seconds": 1, "steps": [{"edge_type": "RemoteCodeExecution", "key_field": "dst"}]}})
    assert [r.chain_key for r in run(spark, [hop(0), admin(5)], motif).completions.collect()] == ["Machine:C"]


def test_definitions_are_checked():
    good = {"window_seconds": 5, "steps": [{"key_field": "src"}]}
    for bad in (
        {**good, "window_seconds": 0}, {**good, "steps": []}, {**good, "colour": 1},
        {**good, "steps": [{"key_field": "middle"}]}, {**good, "steps": [{"key_field": "src", "protocol": "Telnet"}]},
        {**good, "steps": [{"key_field": "src", "key_resolver": "nobody"}]},
    ):
        with pytest.raises(ValueError):
            load_motifs({"m": bad})


def outcome(result):
    done = sorted((r.motif_name, r.chain_key, tuple(r.matched_edges), r.completed_at, r.confidence) for r in result.completions.collect())
    reset = sorted((r.motif_name, r.chain_key, r.triggering_edge_id, tuple(r.matched_edges), r.reset_at) for r in result.resets.collect())
    left = sorted((r.motif_name, r.chain_key, r.stage, tuple(r.matched_edges)) for r in result.open_chains.collect())
    return done, reset, left


# a step may follow itself: an edge that fits both steps of one key completes alone
SELF = load_motifs({"self": {"window_seconds": 900, "steps": [
    {"edge_type": "Authentication", "key_field": "dst"}, {"dst_type": "Machine", "key_field": "dst"}]}})


@pytest.mark.parametrize("hot_rows", [10**6, 50])
@pytest.mark.parametrize("name", ["seed", "seed_fuzzy", "self", "three", "timeout", "pruned", "pruned_timeout"])
def test_equals_walk(spark, name, hot_rows):
    df = random_edges(spark, 900, seed=11)
    motifs = {"self": SELF, "three": THREE_STEP}.get(name, load_motifs())
    fuzzy = name == "seed_fuzzy"
    options = {"timeout": "event_time"} if "timeout" in name else {}
    prunes = None
    if "pruned" in name:
        rng = random.Random(2)
        prunes = [(r.edge_id, r.t_e + rng.choice([0.0, 40.0, 900.0, 4000.0])) for r in df.collect() if rng.random() < 0.6]
        options["prunes"] = spark.createDataFrame(prunes, "edge_id string, pruned_at double")
    cands = M.motif_candidates(df, motifs, fuzzy).collect()
    expected = walk_chains(cands, 0.5, "timeout" in name, prunes)
    result = M.run_motifs(df, motifs, fuzzy=fuzzy, hot_rows=hot_rows, **options)
    assert outcome(result) == expected
    assert len(expected[0]) > 10
    if prunes:
        assert len(expected[1]) > 10


def test_chains_containing(spark):
    df = edges(spark, [hop(0), hop(5, "A", "Z")])
    gone = df.filter("t_e = 5").select("edge_id")
    hit = M.chains_containing(M.open_chains(df, AB), gone).collect()
    assert [(r.chain_key, r.edge_id) for r in hit] == [("Machine:Z", gone.first().edge_id)]
