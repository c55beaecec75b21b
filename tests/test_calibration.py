import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ebbgraph.config import DecayConfig
from ebbgraph.operators import calibration as K
from ebbgraph.operators import decay
from helpers import edges, random_edges


def hourly(spark, n, protocol="RDP"):
    return edges(spark, [("User:a", "Machine:b", "Authentication", protocol, 3600.0 * i, 1.0) for i in range(n)])


@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_gaps(spark, hot_rows):
    df = random_edges(spark, 400)
    last, expected = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.t_e, r.edge_id)):
        gap = r.t_e - last.get((r.src, r.protocol), r.t_e)
        if gap > 0:
            expected[r.edge_id] = gap
        last[r.src, r.protocol] = r.t_e
    assert {r.edge_id: r.gap for r in K.inter_arrival_gaps(df, hot_rows).collect()} == expected


def test_gap_cases(spark):
    df = edges(spark, [
        ("User:alice", "Machine:b", "Authentication", "RDP", 0.0, 1.0),
        ("User:alice", "Machine:c", "Authentication", "RDP", 100.0, 1.0),
        ("User:bob", "Machine:b", "FileTransfer", "SMB", 50.0, 1.0),
    ])
    assert [(r.protocol, r.gap) for r in K.inter_arrival_gaps(df).collect()] == [("RDP", 100.0)]


@pytest.mark.parametrize("split", [False, True])
def test_calibrate(spark, split):
    rows = {r.protocol: r for r in K.calibrate_decay(hourly(spark, 40), split=split).collect()}
    assert set(rows) == {"RDP", "SMB", "Kerberos", "DNS"}
    rdp = rows["RDP"]
    assert (rdp.sample_count, rdp.median_gap_seconds, rdp.suggested_half_life_hours, rdp.sufficient_data) == (39, 3600.0, 1.0, True)
    assert rdp.suggested_lambda_p == pytest.approx(math.log(2) / 3600)
    assert (rows["DNS"].sample_count, rows["DNS"].median_gap_seconds, rows["DNS"].sufficient_data) == (0, None, False)


def test_recalibrate_cases(spark):
    free = K.adaptive_recalibration(hourly(spark, 41), DecayConfig(rates={"RDP": 0.001}), 10.0, tick_edges=40).collect()
    assert [(r.sample_count, r.t) for r in free] == [(39, 39 * 3600.0)]
    assert free[0].applied_lambda_p == pytest.approx(math.log(2) / 3600)
    held = K.adaptive_recalibration(hourly(spark, 41), DecayConfig(rates={"RDP": 0.001}), 0.1, tick_edges=40).collect()
    assert held[0].applied_lambda_p == pytest.approx(0.0009)
    assert K.adaptive_recalibration(hourly(spark, 20), tick_edges=10).count() == 0


def follow(rows, rates, window, tick, least, change):
    """Rate changes by observing edges one after the other."""
    last, gaps, out = {}, {}, []
    for i, r in enumerate(rows):
        before = last.get((r.src, r.protocol))
        last[r.src, r.protocol] = r.t_e
        if before is not None and r.t_e > before:
            gaps.setdefault(r.protocol, []).append(r.t_e - before)
        if (i + 1) % tick:
            continue
        for protocol, seen in gaps.items():
            recent = seen[-window:]
            if len(recent) < least:
                continue
            suggested = math.log(2) / statistics.median(recent)
            current = rates[protocol]
            applied = min(max(suggested, current * (1 - change)), current * (1 + change))
            if applied != current:
                out.append((protocol, r.t_e, len(recent), current, suggested, applied))
                rates[protocol] = applied
    return sorted(out, key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("split, hot_rows", [(False, 10**6), (True, 10**6), (True, 12)])
def test_adaptive_equals_following_edges(spark, split, hot_rows):
    df = random_edges(spark, 800, seed=4)
    base = DecayConfig()
    rows = sorted(df.collect(), key=lambda r: (r.t_e, r.edge_id))
    expected = follow(rows, dict(base.rates), 50, 20, 10, 0.25)
    medians = K.rolling_gap_medians(df, min_samples=10, window_gaps=50, tick_edges=20, split=split)
    got = K.recalibrate(medians, base, 0.25, hot_rows).orderBy("protocol", "t").collect()
    assert len(expected) > 40
    assert [(r.protocol, r.t, r.sample_count) for r in got] == [x[:3] for x in expected]
    for r, x in zip(got, expected):
        assert (r.previous_lambda_p, r.suggested_lambda_p, r.applied_lambda_p) == pytest.approx(x[3:], rel=1e-12)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot_rows", [None, 8])
@pytest.mark.parametrize("first", [0.004, 0.0, 5.0])
def test_recalibrate_blocks_equal_walking_ticks(spark, hot_rows, first):
    """Suggestions that jump between far values never bring two rates together; calm ones do at once."""
    rng, rows = random.Random(5), []
    for protocol, median in (("wild", lambda i: 2.0 if i % 2 else 9e6), ("calm", lambda i: 60.0), ("mixed", lambda i: rng.choice([1.0, 50.0, 60.0, 1e7]))):
        rows += [(i, 10.0 * i, protocol, 30 + i, median(i)) for i in range(32) if protocol != "mixed" or i % 3]
    medians = spark.createDataFrame(rows, "tick long, t double, protocol string, sample_count int, median double")
    changes = K.recalibrate(medians, DecayConfig(rates={"wild": first, "calm": 0.5}, default_lambda=first), 0.25, hot_rows)
    expected, current = [], {"wild": first, "calm": 0.5, "mixed": first}
    for tick, t, protocol, count, median in sorted(rows, key=lambda r: (r[2], r[0])):
        now, suggested = current[protocol], math.log(2) / median
        applied = suggested if now <= 0 else min(max(suggested, now * 0.75), now * 1.25)
        if applied != now:
            expected.append((protocol, now, suggested, applied, count, t))
        current[protocol] = applied
    assert [tuple(r) for r in changes.orderBy("protocol", "t").collect()] == expected
    assert "MapInPandas" not in plan(changes)


def test_recalibrate_of_nothing(spark):
    medians = spark.createDataFrame([], "tick long, t double, protocol string, sample_count int, median double")
    assert K.recalibrate(medians).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_window_medians_equal_slices(spark, size):
    rng = random.Random(size)
    gaps = {p: [float(rng.randrange(1, 50)) for _ in range(n)] for p, n in (("a", 120), ("b", 3), ("c", 41))}
    # of "c" only the newest gaps are known, as after earlier batches
    known = [(p, i + 1, g) for p, values in gaps.items() for i, g in enumerate(values) if p != "c" or i >= 41 - size]
    ends = [("a", n) for n in (1, 2, size, 50, 119, 120) if n <= 120] + [("b", 3), ("c", 41)]
    got = K._window_medians(
        spark.createDataFrame(sorted(set(ends)), "protocol string, upto long"),
        spark.createDataFrame(known, "protocol string, number long, gap double"), size,
    )
    windows = {(p, n): gaps[p][max(0, n - size):n] for p, n in ends}
    assert {(r.protocol, r.upto): (r.sample_count, r.median) for r in got.collect()} == {
        k: (len(w), statistics.median(w)) for k, w in windows.items()
    }


def test_rates_in_force(spark):
    df = random_edges(spark, 300)
    marks = [("SMB", 1000.0, 0.25), ("SMB", 6000.0, 0.5), ("SMB", 6000.0, 0.125), ("RDP", 0.0, 0.75), ("none", 5.0, 0.1)]
    at = df.filter("protocol = 'SMB'").orderBy("t_e").first()["t_e"]
    marks.append(("SMB", at, 0.0625))  # holds for the edge of that time itself
    changes = spark.createDataFrame(marks, "protocol string, t double, applied_lambda_p double")
    config = DecayConfig()
    got = decay.rates_in_force(df.withColumn("lambda_p", F.lit(9.0)), changes, config)
    rows = got.collect()
    assert sorted(got.columns) == sorted([*df.columns, "lambda_p"]) and len(rows) == df.count()
    for r in rows:
        before = [(t, rate) for p, t, rate in marks if p == r.protocol and t <= r.t_e]
        assert r.lambda_p == (max(before)[1] if before else config.rates[r.protocol])
    assert {r.edge_id for r in decay.rates_in_force(df, changes.limit(0)).collect()} == {r.edge_id for r in rows}
