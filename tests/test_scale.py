import random
import statistics

import pytest
from pyspark.sql import functions as F

from ebbgraph.operators import scale


def numbers(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), rng.choice([rng.uniform(0.001, 5), float(rng.randrange(1, 9)), 3600.0]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x double, i int")


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_median(spark, split, n):
    rows, df = numbers(spark, n)
    got = {r.g: (r.n, r["median"]) for r in scale.exact_median(df, "g", "x", split=split).collect()}
    groups = {g: [x for h, x, _ in rows if h == g] for g in {r[0] for r in rows}}
    assert {g: v[0] for g, v in got.items()} == {g: len(v) for g, v in groups.items()}
    for g, values in groups.items():
        assert got[g][1] == pytest.approx(statistics.median(values), rel=1e-12)


def test_exact_median_of_one_repeated_value(spark):
    df = spark.createDataFrame([("a", 7.5)] * 40 + [("a", None)], "g string, x double")
    assert [tuple(r) for r in scale.exact_median(df, "g", "x", split=True).collect()] == [("a", 40, 7.5)]


@pytest.mark.parametrize("split", [False, True])
def test_prefix_sums(spark, split):
    rows, df = numbers(spark)
    got = {r.i: r.total for r in scale.prefix_sums(df, ["g"], ["i"], {"total": F.lit(2)}, split=split).collect()}
    seen, expected = {}, {}
    for g, _, i in rows:
        seen[g] = seen.get(g, 0) + 2
        expected[i] = seen[g]
    assert got == expected


@pytest.mark.parametrize("split", [False, True])
def test_dense_index(spark, split):
    rows, df = numbers(spark)
    got = [(r.x, r.i) for r in scale.dense_index(df, ["x", "i"], "n", split=split).orderBy("n").collect()]
    assert got == sorted((x, i) for _, x, i in rows)


def test_carry_last(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, None, None, float(i)])) for i in range(200)]
    got = scale.carry_last(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], ["i"], "x", "held").collect()
    seen, expected = {}, {}
    for g, i, x in rows:
        seen[g] = seen.get(g) if x is None else x
        expected[i] = seen[g]
    assert {r.i: r.held for r in got} == expected


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 5 + [("c",)] * 20, "k string")
    assert [tuple(r) for r in scale.hot_keys(df, ["k"], 10).orderBy("k").collect()] == [("a", 30), ("c", 20)]
    assert scale.hot_keys(df, ["k"], 100) is None
    cold, hot = scale.segment_hot(df.withColumn("t", F.monotonically_increasing_id()), ["k"], ["t"], 10)
    assert cold.count() == 5 and hot.count() == 50
    assert hot.groupBy("_seg").count().agg(F.max("count")).first()[0] < 30


def test_hot_keys_relative_to_a_partition(spark, monkeypatch):
    monkeypatch.setattr(scale, "LEAST_HOT", 10)
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 20 + [(str(i),) for i in range(50)], "k string")
    assert [tuple(r) for r in scale.hot_keys(df, ["k"]).collect()] == [("a", 90)]  # four partitions: twice 40 rows
    monkeypatch.setattr(scale, "LEAST_HOT", 100)
    assert scale.hot_keys(df, ["k"]) is None


def test_segments_are_bounded(spark):
    df = spark.range(2000).selectExpr("'a' AS k", "id AS t")
    _, hot = scale.segment_hot(df, ["k"], ["t"], 3)
    assert hot.select("_seg").distinct().count() <= 16


def test_scratch_scope_deletes(spark, tmp_path):
    with scale.scratch_scope():
        stored = scale.materialize(spark.range(3))
        path = stored.inputFiles()[0]
        assert stored.count() == 3
    from pathlib import Path
    from urllib.parse import urlparse

    assert not Path(urlparse(path).path).exists()


def test_scratch_must_be_shared_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        scale.scratch_dir(Session)
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "/shared/x")
    assert scale.scratch_dir(Session) == "/shared/x"
