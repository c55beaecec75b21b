import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbgraph.llm import quality

SF = "/root/testdata/sf0.1"


def test_estimated_accuracies_of_simulated_labellers():
    rnd = random.Random(1)
    true = (0.95, 0.8, 0.7)
    for known in (0.0, 0.1):
        counts, right = {}, {}
        for _ in range(40_000):
            bad = rnd.random() < 0.3
            number = 0
            for accuracy in (*true, 0.5, 0.5, 0.5, 0.5):
                vote = quality.NOTHING if rnd.random() < 0.2 else quality.BAD if bad == (rnd.random() < accuracy) else quality.GOOD
                number = 3 * number + vote
            key = number, (int(bad) if rnd.random() < known else None)
            counts[key] = counts.get(key, 0) + 1
            right.setdefault(number, []).append(bad)
        chance, accuracy = quality.estimate(counts, "low")
        assert np.allclose(accuracy[:3], true, atol=0.05)
        assert sum(abs(chance[n] * len(r) - sum(r)) for n, r in right.items()) / 40_000 < 0.1
    assert quality.estimate({}, "toxic")[0] == {}


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # a copy of a training document is no held-out document
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality.rate(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").collect()
    for name, p in (("quality", "p_low"), ("toxic", "p_toxic")):
        bad = [r for r in scored if r[name] == (0 if name == "quality" else 1)]
        good = [r for r in scored if r[name] == (1 if name == "quality" else 0)]
        assert len(bad) > 15
        assert sum(r[p] >= 0.5 for r in bad) / len(bad) > {"quality": 0.97, "toxic": 0.8}[name]
        assert sum(r[p] >= 0.5 for r in good) / len(good) < 0.01


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, "x " * 30_000), (None, "!!! ### $$$ " * 50), (5, "you idiot moron"), (5, "you idiot moron"), (6, "calm words in a calm text")]
    return spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, chances int, p string")


def test_odd_documents_and_labels(spark, odd):
    labels = spark.createDataFrame([(5, 1, 1), (5, None, 0), (None, 0, 0), (77, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.rate(odd, labels).collect()
    assert len(got) == 7 and all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert len({(r.p_low, r.p_toxic) for r in got if r.doc_id == 5}) == 1
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_without_labels_or_documents(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate(odd, none).count() == 7
    assert quality.rate(odd.where("false"), none).count() == 0


def test_learned_words_decide():
    rows = [sorted({*range(10), 100 + i % 3} if i % 4 else {*range(10), 50}) for i in range(400)]
    targets = np.array([0.0 if i % 4 else 1.0 for i in range(400)])
    weights, bias = quality.fit(rows, targets)
    assert bias + weights[list(range(10))].sum() + weights[50] > 0 > bias + weights[list(range(10))].sum() + weights[100]
    assert not weights[:10].any()


@pytest.fixture(scope="module")
def labelled(spark):
    texts = [(i, f"plain w{i % 7} text v{i % 11} of some words" if i % 3 else f"you idiot w{i % 5} moron stupid u{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs, docs.where("doc_id < 300").selectExpr("doc_id", "1 as quality", "int(doc_id % 3 = 0) as toxic")


def test_posteriors_count_where_labels_exceed_the_sample(labelled, monkeypatch):
    estimate, fitted = quality.estimate, []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, targets, certain, *a: fitted.append((len(rows), int((~certain).sum()))) or fit(rows, targets, certain, *a))
    usual = quality.train(*labelled, sample=200)[0]
    monkeypatch.setattr(quality, "estimate", lambda *a: ({p: 1 - x for p, x in estimate(*a)[0].items()}, []))
    changed = quality.train(*labelled, sample=200)[0]
    assert fitted == [(200, 50)] * 4
    assert any(not np.array_equal(a, b) or x != y for (a, x), (b, y) in zip(usual.models, changed.models))


@pytest.mark.parametrize("sample, without", [(380, 95), (396, 99), (1000, 100), (320, 80)])
def test_share_without_labels(labelled, monkeypatch, sample, without):
    fit, fitted = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda rows, targets, certain, *a: fitted.append((len(rows), int((~certain).sum()))) or fit(rows, targets, certain, *a))
    quality.train(*labelled, sample=sample)
    assert fitted == [(min(sample, 400), without)] * 2


def test_repeated_rows_do_not_crowd_the_sample(spark, labelled, monkeypatch):
    docs, labels = labelled
    again = docs.where("doc_id = 0").crossJoin(spark.range(150)).select("doc_id", "text")
    fit, fitted = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda rows, *a: fitted.append([tuple(r) for r in rows]) or fit(rows, *a))
    quality.train(docs, labels, sample=200)
    quality.train(docs.unionByName(again), labels, sample=200)
    assert len(fitted[2]) == 200 and fitted[2] == fitted[0]
