import random

import pytest

from ebbgraph.operators import baseline
from helpers import edges, ewma, random_edges


def series(spark, values, src="User:a", protocol="RDP"):
    return edges(spark, [(src, "Machine:m", "Authentication", protocol, float(i), v) for i, v in enumerate(values)])


def signals(df, **options):
    return baseline.deviation_signals(df, **options).orderBy("entity", "protocol", "t").collect()


def same(rows, expected):
    assert len(rows) == len(expected)
    for row, (z, mean, std, n) in zip(rows, expected):
        assert row.sample_count == n
        assert row.baseline_mean == pytest.approx(mean, rel=1e-12, abs=1e-12)
        assert row.baseline_std == pytest.approx(std, rel=1e-9, abs=1e-12)
        assert (row.z_score is None) == (z is None), n
        if z is not None:
            assert row.z_score == pytest.approx(z, rel=1e-8, abs=1e-9)


def test_short_histories(spark):
    assert [r.z_score for r in signals(series(spark, [1.0]))] == [None]
    assert [r.z_score for r in signals(series(spark, [1.0, 1.0, 1.0]))] == [None] * 3
    rows = signals(series(spark, [1.0 if i % 2 else 1.01 for i in range(10)] + [50.0]))
    assert rows[-1].z_score > 5


def test_keys_are_separate(spark):
    df = series(spark, [1.0, 2.0]).unionByName(series(spark, [3.0], protocol="SMB")).unionByName(series(spark, [4.0], "User:b"))
    assert sorted((r.entity, r.protocol, r.sample_count) for r in signals(df)) == [
        ("User:a", "RDP", 1), ("User:a", "RDP", 2), ("User:a", "SMB", 1), ("User:b", "RDP", 1)
    ]


@pytest.mark.parametrize("alpha", [0.3, 0.01, 0.9])
@pytest.mark.parametrize("hot_rows", [10**6, 90])
def test_equals_recursion(spark, alpha, hot_rows):
    rng = random.Random(5)
    values = [round(rng.lognormvariate(0, 1), 3) for _ in range(700)]
    same(signals(series(spark, values), alpha=alpha, hot_rows=hot_rows), ewma(values, alpha))


@pytest.mark.parametrize("hot_rows", [10**6, 100])
def test_constant_then_change(spark, hot_rows):
    rows = signals(series(spark, [2.0] * 300 + [7.0]), hot_rows=hot_rows)
    assert all(r.z_score is None for r in rows)  # no spread before the first change
    rows = signals(series(spark, [0.6] + [1.0] * 400 + [0.6]), hot_rows=hot_rows)
    assert rows[-1].z_score < -1000
    assert all(abs(r.z_score) < 3 for r in rows[40:-1])


def test_hot_and_cold_keys_together(spark):
    df = random_edges(spark, 900)
    plain = {r.edge_id: r for r in signals(df)}
    split = {r.edge_id: r for r in signals(df, hot_rows=60)}
    assert plain.keys() == split.keys() and len(plain) == df.count()
    for key, row in plain.items():
        assert split[key].sample_count == row.sample_count
        assert (split[key].z_score is None) == (row.z_score is None)
        assert (split[key].z_score or 0) == pytest.approx(row.z_score or 0, rel=1e-9, abs=1e-9)


def test_newest_value_only(spark):
    rows = signals(series(spark, [1.0, 5.0, 2.0]), alpha=1)
    assert [(r.baseline_mean, r.baseline_std, r.z_score) for r in rows] == [(1.0, 0.0, None), (5.0, 0.0, None), (2.0, 0.0, None)]
    with pytest.raises(ValueError):
        baseline.deviation_signals(series(spark, [1.0]), alpha=0)


def test_latest_deviation_ignores_null(spark):
    df = spark.createDataFrame(
        [("a", "RDP", 1.0, 4.0, "e1"), ("a", "SMB", 2.0, None, "e2"), ("b", "RDP", 1.0, None, "e3")],
        "entity string, protocol string, t double, z_score double, edge_id string",
    )
    assert [(r.entity, r.z_score) for r in baseline.latest_deviation(df).collect()] == [("a", 4.0)]
    assert [r.edge_id for r in baseline.flag_anomalies(df, 4.0).collect()] == ["e1"]
