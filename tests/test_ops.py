import random

import pytest
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig
from ebbgraph.operators import baseline, forensics, graph, motifs as M, ops
from ebbgraph.schema import COLD_EDGE, FEEDBACK, RESET
from ebbgraph.sources import config_table, tables
from helpers import edges, random_edges


def cold(spark, *rows):
    full = [(e, s, d, "Authentication", p, t, 1.0, 0.1, at, "x", None) for e, s, d, p, t, at in rows]
    return spark.createDataFrame(full, COLD_EDGE)


def test_forensics(spark):
    table = cold(
        spark, ("e1", "User:a", "Machine:m", "RDP", 100.0, 900.0), ("e2", "Machine:m", "Machine:n", "SMB", 150.0, 950.0),
        ("e3", "User:a", "Machine:m", "RDP", 500.0, 990.0), ("e4", "User:z", "Machine:n", "RDP", 120.0, 10.0),
    )
    assert [r.edge_id for r in forensics.reconstruct_activity(table, "Machine:m", 0, 200).collect()] == ["e1", "e2"]
    assert [(r.edge_id, r.other) for r in forensics.newest_activity(table, "Machine:m", 2).collect()] == [("e3", "User:a"), ("e2", "Machine:n")]
    assert [(r.protocol, r.prunes) for r in forensics.prunes_by_protocol(table, 900, 1000).collect()] == [("RDP", 2), ("SMB", 1)]
    assert forensics.get_edge(table, "e4").first().src == "User:z" and forensics.get_edge(table, "nope").count() == 0
    assert forensics.deduplicate_cold(table.unionByName(table)).count() == 4
    windows = spark.createDataFrame([("Machine:m", 0.0, 200.0), ("User:z", 0.0, 1.0)], "entity string, start double, end double")
    assert sorted(r.edge_id for r in forensics.reconstruct_many(table, windows).collect()) == ["e1", "e2"]
    alerts = spark.createDataFrame([("m", "k", ["e2", "gone", "e1"], 5.0)], "motif_name string, chain_key string, matched_edges array<string>, completed_at double")
    assert [(r.position, r.edge_id) for r in forensics.alert_edges(alerts, table).orderBy("position").collect()] == [(0, "e2"), (2, "e1")]


def test_audit(spark, tmp_path):
    resets = spark.createDataFrame([("m", "Machine:B", "e1", ["e1"], 5.0)], RESET)
    records = ops.audit_records(cold(spark, ("e1", "User:a", "Machine:m", "RDP", 1.0, 9.0)), resets)
    tables.write_audit(records, str(tmp_path / "audit"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "audit")).collect())
    assert len(lines) == 2 and '"type":"motif_reset"' in lines[1] or '"type":"motif_reset"' in lines[0]
    assert all('"logged_at":' in x for x in lines)
    assert not any('"edge_id"' in x and "motif_reset" in x for x in lines)


def test_rate_cases(spark):
    at = lambda times, now, w: ops.rate_at(spark.createDataFrame([(float(t),) for t in times], "t double"), "t", now, w).first().rate
    assert at([0, 2, 4], 5, 10) == pytest.approx(0.3)
    assert at([0, 5], 20, 10) == 0
    assert at([0, 5], 15, 10) == pytest.approx(0.1)  # the window edge counts
    assert at([0], 0, 0) == 0


@pytest.mark.parametrize("split", [False, True])
def test_rolling_rate(spark, split):
    rng = random.Random(8)
    times = [float(rng.randrange(0, 400)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    got = {r.t: round(r.rate * 60) for r in ops.rolling_rate(df, "t", 60.0, split=split).collect()}
    assert got == {t: sum(t - 60 <= x <= t for x in times) for t in set(times)}


def test_snapshot(spark):
    graph_edges = edges(spark, [("User:a", "Machine:b", "Authentication", "RDP", 1.0, 1.0)])
    done = spark.createDataFrame([(100.0,)], "completed_at double")
    none = spark.createDataFrame([], "reset_at double")
    passes = spark.createDataFrame([(1.0, 0.1), (5.0, 0.2)], "t double, epsilon double")
    row = ops.metrics_snapshot(120.0, graph_edges, cold(spark), done, none, passes).first()
    assert tuple(row) == (1, 0.0, 0.2, pytest.approx(1 / 60), 0.0, None)
    assert [r.t for r in ops.last_readings(passes, 1).collect()] == [5.0]


def test_feedback(spark):
    rows = [("m", "k", "true_positive", 1.0, None)] * 8 + [("m", "k", "false_positive", 1.0, None)] * 2 + [("q", "k", "false_positive", 1.0, None)]
    df = spark.createDataFrame(rows, FEEDBACK)
    ranked = ops.ranked_motifs(df).collect()
    assert [(r.motif_name, r.true_positives, r.false_positives) for r in ranked] == [("m", 8, 2), ("q", 0, 1)]
    assert ranked[0].priority_score == pytest.approx(9 / 12)
    assert ops.priority_of(df, "unseen").first().priority_score == 0.5
    with pytest.raises(Exception, match="unknown disposition maybe"):
        ops.motif_priority(spark.createDataFrame([("m", "k", "maybe", 1.0, None)], FEEDBACK)).collect()


def test_scores(spark):
    base = [("User:A", "User:B", "Authentication", "RDP", 1.0, 1.0), ("User:B", "User:C", "Authentication", "RDP", 2.0, 1.0)]
    z = lambda *rows: spark.createDataFrame(list(rows), "entity string, z_score double")
    run = lambda rows, dev=z(), **o: {r.entity_id: r.score for r in graph.score_entities(edges(spark, rows), dev, **o).collect()}
    plain = run(base)
    assert set(plain) == {"User:A", "User:B", "User:C"}
    assert set(run(base[1:])) == {"User:B", "User:C"}
    loud = run(base, z(("User:A", 5.0)))
    assert loud["User:A"] != plain["User:A"] and loud["User:B"] != plain["User:B"]
    only = spark.createDataFrame([("User:A",), ("User:gone",)], "entity_id string")
    assert set(run(base, only=only)) == {"User:A"}


def test_alert_neighborhood(spark):
    df = edges(spark, [
        ("Machine:A", "Machine:B", "Authentication", "RDP", 1.0, 1.0), ("Machine:B", "Machine:C", "Authentication", "RDP", 2.0, 1.0),
        ("Machine:X", "Machine:Y", "Authentication", "RDP", 3.0, 1.0),
    ])
    done = spark.createDataFrame([("m", "Machine:B", 7.0), ("m", "Machine:B", 9.0)], "motif_name string, chain_key string, completed_at double")
    z = spark.createDataFrame([], "entity string, z_score double")
    rows = graph.score_alert_neighborhoods(done, df, z)
    assert sorted((r.entity_id, r.t, r.alerts) for r in rows.collect()) == [(f"Machine:{x}", 9.0, 2) for x in "ABC"]
    assert sorted((r.entity_id, r.t) for r in graph.per_alert(rows, done).collect()) == [(f"Machine:{x}", t) for x in "ABC" for t in (7.0, 9.0)]
    assert {r.trigger for r in rows.collect()} == {"motif_completion"}
    ranked = graph.top_entities(graph.score_entities(df, z), 2).collect()
    assert len(ranked) == 2 and abs(ranked[0].score) >= abs(ranked[1].score)


def test_config_table(spark, tmp_path):
    path = str(tmp_path / "rates")
    config_table.upsert_lambdas(spark, path, {"RDP": 0.5}, 0)
    config_table.upsert_lambdas(spark, path, {"RDP": 0.7, "X": 0.1}, 1)
    config = config_table.load_decay_config(spark, path)
    assert (config.rates["RDP"], config.rates["X"], config.rates["SMB"]) == (0.7, 0.1, DecayConfig().rates["SMB"])
    assert config_table.load_decay_config(spark, path, before=1).rates["RDP"] == 0.5


def test_config_from_yaml(tmp_path):
    from ebbgraph.config import decay_config_from_yaml, motifs_from_yaml

    (tmp_path / "p.yaml").write_text("default_lambda_p: 0.5\nprotocols:\n  RDP:\n    lambda_p: 0.25\n")
    config = decay_config_from_yaml(str(tmp_path / "p.yaml"))
    assert config.default_lambda == 0.5 and config.rates == {"RDP": 0.25}
    (tmp_path / "m.yaml").write_text("motifs:\n  m:\n    window_seconds: 5\n    steps:\n      - key_field: src\n        protocol: [RDP, SMB]\n")
    assert motifs_from_yaml(str(tmp_path / "m.yaml"))[0].steps[0].protocols == ("RDP", "SMB")


def test_partitioned_write(spark, tmp_path):
    df = edges(spark, [(f"User:u{i}", "Machine:m", "Authentication", "RDP", float(i), 1.0) for i in range(20)])
    graph.write_partitioned(df, str(tmp_path / "g"), 4)
    back = spark.read.parquet(str(tmp_path / "g"))
    assert back.count() == 20 and back.filter(F.col("shard") >= 4).count() == 0


def test_alert_scores_average_only_what_they_need(spark):
    df = random_edges(spark, 150, seed=8)
    far = edges(spark, [(f"Machine:far{i}", f"Machine:far{i + 1}", "Authentication", "SMB", float(i), 1.0) for i in range(40)])
    everything = df.unionByName(far)
    alerts = M.match_motifs(df).limit(2)
    z = baseline.latest_deviation(baseline.deviation_signals(df))
    area = graph.alert_neighborhood(alerts, everything).select("entity_id")
    whole = {r.entity_id: r.score for r in graph.score_entities(everything, z, area).collect()}
    got = {r.entity_id: r.score for r in graph.score_alert_neighborhoods(alerts, everything, z).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-12 for k in got)
    needed = graph.scoring_edges(everything, area)
    assert needed.filter("src like 'Machine:far%'").isEmpty() and needed.count() <= df.count()


def spoil(path, days):
    """Make the files of some day folders unreadable."""
    for day in days:
        for file in (path / f"day={day}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


def days_of_cold(spark, path, days=12):
    rows = [(f"e{d}-{i}", "User:a" if i % 10 == 0 else f"User:u{d}-{i}", f"Machine:m{i}", "RDP", 86400.0 * d + i, 9e6) for d in range(days) for i in range(30)]
    tables.write_cold_edges(cold(spark, *rows), str(path))
    return cold(spark, *rows)


def test_newest_edges_open_the_newest_days(spark, tmp_path):
    path = tmp_path / "cold"
    table = days_of_cold(spark, path)
    assert tables.cold_days(spark, str(path))[:2] == ["1970-01-12", "1970-01-11"]
    everything = forensics.newest_activity(table, "User:a", 100).collect()
    assert forensics.newest_stored(spark, str(path), "User:a", 100).collect() == everything and len(everything) == 36
    spoil(path, [f"1970-01-{d:02d}" for d in range(1, 10)])
    got = forensics.newest_stored(spark, str(path), "User:a", 7)  # three edges a day: one day, then two more
    assert [r.t_e for r in got.collect()] == [r.t_e for r in everything[:7]]


def test_alert_edges_open_the_days_of_their_windows(spark, tmp_path):
    path = tmp_path / "cold"
    days_of_cold(spark, path)
    spoil(path, [f"1970-01-{d:02d}" for d in (*range(1, 6), *range(9, 13))])
    alerts = spark.createDataFrame(
        [("m", "k", ["e6-29", "e7-3", "gone"], 86400.0 * 7 + 3, 1.0)],
        "motif_name string, chain_key string, matched_edges array<string>, completed_at double, confidence double",
    )
    stored = tables.read_cold_edges(spark, str(path), by_day=True)
    assert sorted((r.position, r.edge_id) for r in forensics.alert_edges(alerts, stored).collect()) == [(0, "e6-29"), (1, "e7-3")]
    assert forensics.alert_edges(alerts.limit(0), stored).count() == 0


def test_lookups_skip_files_by_bloom_filter(spark, tmp_path):
    path = tmp_path / "cold"
    days_of_cold(spark, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for column, value, least, most in (("edge_id", "e5-7", 1, 60), ("src", "User:u3-4", 1, 60), ("edge_id", "e5-7x", 0, 30)):
            found = tables.read_cold_edges(spark, str(path)).filter(F.col(column) == value)
            assert found.count() == least
            rows = found.select("t_e")
            rows.collect()
            leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
            assert leaves.head().metrics().apply("numOutputRows").value() <= most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
