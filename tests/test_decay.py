import math

import pytest
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig
from ebbgraph.functions import columns as C
from ebbgraph.operators import decay
from ebbgraph.plans import runs
from ebbgraph.sources import tables
from helpers import edges, random_edges


def one(spark, protocol="RDP", t_e=0.0, w_0=1.0):
    return edges(spark, [("User:a", "Machine:b", "Authentication", protocol, t_e, w_0)])


def test_weight(spark):
    config = DecayConfig(rates={"RDP": 0.01})
    at = lambda t: decay.refresh_weights(one(spark, t_e=5.0, w_0=2.0), t, config).first().w
    assert at(15.0) == pytest.approx(2 * math.exp(-0.1))
    assert at(1.0) == 2.0
    unknown = decay.with_lambda(one(spark, protocol="Telnet")).first()
    assert unknown.lambda_p == 0.0000198


def test_epsilon(spark):
    value = lambda n, **k: spark.range(1).select(C.epsilon(F.lit(n), **k)).first()[0]
    assert value(0, epsilon_min=0, epsilon_max=1, memory_percent=80) == pytest.approx(0.5)
    assert value(100, epsilon_min=0, epsilon_max=1, max_edges=100) == pytest.approx(1.0)
    assert value(500, epsilon_min=0.2, epsilon_max=1, max_edges=0) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        C.epsilon(F.lit(1), 1.0, 0.5)
    with pytest.raises(ValueError):
        C.epsilon(F.lit(1), 0.0, 0.5, low_watermark=90, high_watermark=90)


def test_prune_pass(spark):
    result = decay.prune_pass(one(spark), 36000.0, decay.PrunePolicy(0.9, 0.9))
    stats = result.stats.first()
    assert (stats.scanned, stats.pruned, stats.write_failures) == (1, 1, 0)
    assert result.cold.first().w_at_prune < 0.9 and result.active.count() == 0
    pressed = decay.prune_pass(one(spark), 60.0, decay.PrunePolicy(0.0, 0.99, max_edges=1)).stats.first()
    assert pressed.epsilon == pytest.approx(0.99) and pressed.pruned == 1
    kept = decay.prune_pass(one(spark), 0.0, decay.PrunePolicy(0.5, 0.5))
    assert kept.active.count() == 1 and kept.cold.count() == 0


def test_schedule_equals_passes(spark):
    df = random_edges(spark, 150, seed=3)
    config = DecayConfig(rates={p: 0.0005 for p in ("RDP", "SMB", "Kerberos", "DNS")})
    times = [1000.0 + 1500.0 * k for k in range(8)]
    replay = runs.prune_replay(df, times, decay.PrunePolicy(0.4, 0.4), config)
    expected = {r.edge_id: r.pruned_at for r in replay.cold.collect()}
    rows = decay.prune_schedule(df, 1000.0, 1500.0, 0.4, config).collect()
    assert {r.edge_id: r.pruned_at for r in rows if r.pruned_at <= times[-1]} == expected
    assert len(expected) > 20


def test_replay_threshold_follows_live_count(spark):
    rows = [(f"User:u{i}", "Machine:m", "Authentication", "RDP", float(i), 1.0) for i in range(40)]
    config = DecayConfig(rates={"RDP": 0.01})
    policy = decay.PrunePolicy(0.1, 0.95, max_edges=20)
    result = runs.prune_replay(edges(spark, rows), [9.0, 19.0, 29.0, 39.0], policy, config)
    live, seen = [], []
    for t in (9.0, 19.0, 29.0, 39.0):
        live += [r for r in rows if t - 10 < r[4] <= t]
        eps = 0.1 + min(1.0, len(live) / 20) * 0.85
        gone = [r for r in live if math.exp(-0.01 * (t - r[4])) < eps]
        seen.append((t, len(live), len(gone)))
        live = [r for r in live if r not in gone]
    assert [(r.t, r.scanned, r.pruned) for r in result.stats.orderBy("t").collect()] == seen
    assert result.active.count() == len(live)


def test_cold_table(spark, tmp_path):
    df = random_edges(spark, 100)
    result = decay.prune_pass(df, 10.0**9, decay.PrunePolicy(0.5, 0.5))
    path = str(tmp_path / "cold")
    tables.write_cold_edges(result.cold, path)
    assert tables.read_cold_edges(spark, path).count() == df.count()
    lo, hi = 1000.0, 20000.0
    wanted = df.filter(F.col("t_e").between(lo, hi)).count()
    assert tables.cold_between(spark, path, lo, hi).count() == wanted > 0
