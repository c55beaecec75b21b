import random

import pytest

from ebbgraph.operators import evaluation as V
from ebbgraph.plans import runs
from helpers import random_edges

LABEL = "t double, user string, source_computer string, destination_computer string"
SIGNAL = "entity string, protocol string, t double, z_score double, edge_id string"
DONE = "motif_name string, chain_key string, matched_edges array<string>, completed_at double, confidence double"


def labels(spark, *rows):
    return spark.createDataFrame(list(rows) or [], LABEL)


def signals(spark, *rows):
    return spark.createDataFrame([(f"User:{u}", "RDP", t, z, f"{u}{t}{z}") for u, t, z in rows], SIGNAL)


def metrics(rated, rated_labels):
    r = V.detection_metrics(rated, rated_labels, "x").first()
    return r.true_positives, r.false_positives, r.false_negatives, r.precision, r.recall


def test_anomaly_cases(spark):
    one = labels(spark, (100.0, "mallory", "C1", "C2"))
    score = lambda *rows: metrics(*V.match_anomalies(signals(spark, *rows), one))
    assert score(("mallory", 110.0, 5.0)) == (1, 0, 0, 1.0, 1.0)
    assert score(("mallory", 110.0, -5.0)) == (1, 0, 0, 1.0, 1.0)
    assert score(("mallory", 110.0, 1.0)) == (0, 0, 1, None, 0.0)
    assert score(("mallory", 110.0, None)) == (0, 0, 1, None, 0.0)
    assert score(("mallory", 7300.0, 5.0)) == (0, 1, 1, 0.0, 0.0)
    assert score(("mallory", 3700.0, 5.0)) == (1, 0, 0, 1.0, 1.0)  # the tolerance is inclusive
    assert score(("bob", 110.0, 5.0)) == (0, 1, 1, 0.0, 0.0)
    nothing = metrics(*V.match_anomalies(signals(spark), labels(spark)))
    assert nothing == (0, 0, 0, None, None)


def test_motif_cases(spark):
    one = labels(spark, (100.0, "svc", "C1", "C2"))

    def score(key, t):
        done = spark.createDataFrame([("m", key, ["e"], t, 1.0)], DONE)
        return metrics(*V.match_motif_alerts(done, one))

    for key in ("Machine:C1", "Machine:C2", "User:svc"):
        assert score(key, 200.0) == (1, 0, 0, 1.0, 1.0)
    assert score("Machine:C9", 200.0) == (0, 1, 1, 0.0, 0.0)
    assert score("Machine:C1", 100.0 + 14401) == (0, 1, 1, 0.0, 0.0)


def test_equal_labels_count_each(spark):
    twice = labels(spark, *[(100.0, "m", "C1", "C2")] * 2, (9e9, "m", "C1", "C2"))
    rated = V.match_anomalies(signals(spark, ("m", 100.0, 9.0)), twice)
    assert metrics(*rated) == (2, 0, 1, 1.0, pytest.approx(2 / 3))
    assert V.false_negatives(rated[1]).count() == 1


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_equals_pairwise(spark, hot_rows):
    rng = random.Random(3)
    who = lambda: rng.choice("aaab")
    raised = [(who(), float(rng.randrange(0, 10**6)), rng.choice([4.0, -6.0, 1.0])) for _ in range(200)]
    marked = [(float(rng.randrange(0, 10**6)), who(), "C1", f"C{i}") for i in range(60)]
    flagged = [s for s in raised if abs(s[2]) >= 3]
    near = lambda s, m: s[0] == m[1] and abs(s[1] - m[0]) <= 3600
    tp = sum(any(near(s, m) for s in flagged) for m in marked)
    fp = sum(not any(near(s, m) for m in marked) for s in flagged)
    rated = V.match_anomalies(signals(spark, *raised), labels(spark, *marked), hot_rows=hot_rows)
    assert metrics(*rated)[:3] == (tp, fp, len(marked) - tp)
    assert rated[0].count() == len(flagged) and 0 < tp < 60 and fp > 0


def test_report_has_both_detectors(spark):
    df = random_edges(spark, 200)
    report = runs.evaluate_detectors(df, labels(spark, (10.0, "u1", "C1", "C2"))).collect()
    assert sorted(r.detector for r in report) == ["anomaly", "motif"]
