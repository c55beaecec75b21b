"""Document quality and toxicity from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over the
whole corpus (a handful of patterns, whatever its size), together with the gold labels that some
documents have; expectation-maximisation on these counts estimates every labeller's accuracy and the
chance that a document of a pattern is bad, gold labels being certain. These posteriors train a linear
scorer on hashed features (a text's distinct words, and ranges of its statistics) by gradient descent,
on at most ``sample`` documents in order of a hash: ``UNLABELLED`` of them without a gold label, whose targets
are the posteriors, at every size, the rest with one; where one kind is short the other fills up. The scorer then rates every whole text.

There are two aspects: ``low`` (junk) and ``toxic``. A document stays if both chances are under a half.

Defined results: a null or empty text has no features beyond its empty statistics and gets the score of
that; repeated rows count once in the sample;
documents without a label, labels without a document and null labels add nothing; of several
labels of a doc_id the worst counts; rows with equal text get equal scores; an empty table gives
an empty result; extra columns are kept by ``keep_good`` and ignored by ``rate``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import chain
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import drop, fresh, rowwise, store, text_key
from ebbgraph.llm.decontaminate import TO_WORDS
from ebbgraph.llm.pieces import Memo

SAMPLE = 8000
UNLABELLED = 0.25  # share of the sample for documents without a gold label
BUCKETS = 1 << 18
LEAST_SCORE = 5.0  # standard deviations that a feature's share of bad documents must lie off the sample's
LEAST_DOCUMENTS = 5  # of the sample, for a feature to get a weight
UNCERTAIN = 0.1  # what a document without a gold label counts beside those with one
ROUNDS = 300
MOST_WEIGHT = 1.5  # of a bad document, where few are bad
PRIOR_STRENGTH = 0.02  # of the penalty on squared weights
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features too
ASPECTS = ("low", "toxic")
NOTHING, GOOD, BAD = 0, 1, 2

UPPER, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
BARE = frozenset(range(33, 48)) | frozenset(range(58, 65)) | frozenset(range(91, 97)) | frozenset(range(123, 127))  # ASCII marks
SYMBOLS = b"#%*$&|@^~=<>{}[]\\"
#: Words of abuse that the lexicon labeller knows; the scorer learns others from labels.
ABUSE = frozenset(
    b"idiot idiots moron morons stupid loser losers scum pathetic worthless trash disgusting clown dumb imbecile jerk scumbag vermin".split()
)


#: What prose usually measures, and for how many words that counts.
USUAL, SHRINK = {"shouting": 0.03, "short": 0.3, "length": 6.5}, 20


def statistics(utf8: bytes) -> tuple[dict[str, float], set[bytes]]:
    """A text's measures, and its distinct words in lower case."""
    words = utf8.split()
    plain = utf8.translate(TO_WORDS).split()
    n, letters = max(len(words), 1), max(len(utf8) - len(utf8.translate(None, LETTERS)), 1)
    distinct = set(plain)
    few, some = n + SHRINK, letters + 5 * SHRINK  # a short text's measures lie near the usual
    return {
        "symbols": (len(utf8) - len(utf8.translate(None, SYMBOLS))) / few,
        "shouting": (len(utf8) - len(utf8.translate(None, UPPER)) + 5 * SHRINK * USUAL["shouting"]) / some,
        "exclaiming": utf8.count(b"!") / few,
        "bare": sum(map(BARE.issuperset, words)) / few,
        "repeating": sum(map(eq, words, words[1:])) / few,
        "short": (sum(map((3).__ge__, map(len, words))) + SHRINK * USUAL["short"]) / few,
        "length": (len(utf8) + SHRINK * USUAL["length"]) / few,
        "abuse": float(len(ABUSE & distinct)),
    }, distinct


#: From what a measure speaks of junk; a labeller for each says bad from there on, else nothing.
LIMITS = {"symbols": 0.3, "shouting": 0.6, "exclaiming": 0.5, "repeating": 0.3, "bare": 0.25, "length": 12.0}
#: Measures that an aspect is judged by; words count for each.
JUDGED_BY = {"low": ("symbols", "shouting", "exclaiming", "bare", "repeating", "short", "length"), "toxic": ("abuse",)}
#: aspect: (measure, good up to, bad from); ``oddness`` is the largest share of its limit that a measure reaches
LABELLERS: dict[str, tuple[tuple[str, float, float], ...]] = {
    "low": (*((name, -1.0, limit) for name, limit in LIMITS.items()), ("oddness", 0.7, 1.0)),
    "toxic": (("abuse", 0.0, 1.0), ("abuse", -1.0, 2.0), ("abuse", -1.0, 4.0)),
}


def pattern(measures: dict[str, float], aspect: str) -> int:
    """All labellers' votes as one number, base 3."""
    out = 0
    for name, good, bad in LABELLERS[aspect]:
        x = max(measures[k] / limit for k, limit in LIMITS.items()) if name == "oddness" else measures[name]
        out = 3 * out + (BAD if x >= bad else GOOD if x <= good else NOTHING)
    return out


def votes_of(number: int, aspect: str) -> list[int]:
    out = []
    for _ in LABELLERS[aspect]:
        number, vote = divmod(number, 3)
        out.append(vote)
    return out[::-1]


def estimate(counts: dict[tuple[int, int | None], int], aspect: str, rounds: int = 50) -> tuple[dict[int, float], list[float]]:
    """Chance of bad for each vote pattern, and each labeller's accuracy where it votes, by expectation-maximisation.

    ``counts``: documents of each (pattern, gold label); the label is 1 for bad, 0 for good, None if unknown.
    """
    if not counts:
        return {}, [math.nan] * len(LABELLERS[aspect])
    keys = list(counts)
    votes = np.array([votes_of(p, aspect) for p, _ in keys])
    n = np.array([counts[k] for k in keys], float)
    gold = np.array([math.nan if g is None else float(g) for _, g in keys])
    known = ~np.isnan(gold)
    bad, good = (votes == BAD).sum(1), (votes == GOOD).sum(1)
    chance = np.where(known, np.nan_to_num(gold), np.where(bad > 0, 0.9, np.where(good > 0, 0.1, 0.5)))
    for _ in range(rounds):
        log = np.zeros((len(keys), 2))
        table = np.empty((votes.shape[1], 2, 3))
        for c, weight in enumerate((n * (1 - chance), n * chance)):
            log[:, c] = math.log((weight.sum() + 1) / (n.sum() + 2))
            for j in range(votes.shape[1]):
                table[j, c] = np.bincount(votes[:, j], weight, 3) + 0.5
                table[j, c] /= table[j, c].sum()
                log[:, c] += np.log(table[j, c, votes[:, j]])
        rated = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        chance = np.where(known, np.nan_to_num(gold), rated)
    share = float((n * chance).sum() / n.sum())
    right = [(1 - share) * t[0, GOOD] + share * t[1, BAD] for t in table]
    cast = [(1 - share) * (t[0, GOOD] + t[0, BAD]) + share * (t[1, GOOD] + t[1, BAD]) for t in table]
    return {p: float(x) for (p, _), x in zip(keys, rated)}, [a / b for a, b in zip(right, cast)]


MEASURES = ("symbols", "shouting", "exclaiming", "bare", "repeating", "short", "length", "abuse")
STEPS = {name: (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.5, 3, 5, 7, 9, 12, 16) for name in MEASURES} | {"abuse": (0, 1, 2, 3)}


def statistic_features(measures: dict[str, float]) -> list[int]:
    """The steps that each measure exceeds, hashed."""
    return [zlib.crc32(f"{k} > {s}".encode()) % BUCKETS for k, x in measures.items() for s in STEPS[k] if x > s]


def word_features(word: bytes) -> tuple[int, ...]:
    """A word and its beginnings, hashed."""
    return zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"^" + word[:n]) % BUCKETS for n in PREFIXES if len(word) >= n)


def hashed(utf8: bytes | None) -> list[int]:
    """The distinct hashed features of a whole text."""
    measures, words = statistics(utf8 or b"")
    return sorted({*statistic_features(measures), *(f for w in words for f in word_features(w))})


def foreign(aspect: str) -> list[int]:
    """The statistic features that do not speak of an aspect."""
    return statistic_features({k: float("inf") for k in MEASURES if k not in JUDGED_BY[aspect]})


def fit(rows: list[list[int]], targets: np.ndarray, certain: np.ndarray | None = None, without: Sequence[int] = (), rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of binary features, by adaptive gradient descent.

    Only features whose share of bad documents clearly differs from the sample's get a weight.
    ``without`` names features that get none. Rows that are not ``certain`` count ``UNCERTAIN`` as much as the others, if there are others.
    """
    weights = np.zeros(BUCKETS, np.float64)
    if not rows:
        return weights, -1.0
    columns = np.concatenate([np.asarray(r, np.int32) for r in rows])
    lines = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    counted = np.where(certain, 1.0, UNCERTAIN) if certain is not None and certain.any() else np.ones(len(rows))
    share = float(np.clip(np.average(targets, weights=counted), 1e-6, 1 - 1e-6))
    seen, bad = (np.bincount(columns, x[lines], BUCKETS) for x in (counted, counted * targets))
    off = np.abs(bad - seen * share) / np.sqrt(np.maximum(seen, 1e-3) * share * (1 - share))
    used = (seen >= LEAST_DOCUMENTS) & (off >= LEAST_SCORE)
    used[list(without)] = False
    inside = used[columns]
    counted = counted * np.where(targets >= 0.5, min(MOST_WEIGHT, (1 - share) / share), 1.0)  # both classes count alike
    kept = np.flatnonzero(used)
    columns, lines = np.searchsorted(kept, columns[inside]), lines[inside]
    small, steps, bias, bias_step = np.zeros(len(kept)), np.full(len(kept), 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        margin = np.bincount(lines, small[columns], len(rows)) + bias
        error = counted * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - targets)
        slope = np.bincount(columns, error[lines], len(kept)) + PRIOR_STRENGTH * small
        steps += slope**2
        small -= 0.5 * slope / np.sqrt(steps)
        bias_step += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(bias_step)
    weights[kept] = small
    return weights, bias


class Scorer:
    """Chances of bad for a text, one for each aspect."""

    def __init__(self, models: list[tuple[np.ndarray, float]]):
        self.models = models
        self.weighed = [frozenset(np.flatnonzero(m).tolist()) for m, _ in models]
        every = frozenset().union(*self.weighed)
        self.by_word = Memo(lambda w: tuple(f for f in word_features(w) if f in every))

    def rate(self, utf8: bytes | None) -> tuple[float, ...]:
        measures, words = statistics(utf8 or b"")
        features = {*statistic_features(measures), *chain.from_iterable(map(self.by_word.__getitem__, words))}
        out = []
        for (weights, bias), weighed in zip(self.models, self.weighed):
            margin = bias + math.fsum(float(weights[f]) for f in features & weighed)
            out.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), 6))
        return tuple(out)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Scorer, dict[str, list[float]]]:
    """The scorer, and the labellers' estimated accuracies by aspect."""

    def make():
        def one(utf8):
            measures, _ = statistics(utf8 or b"")
            return tuple(pattern(measures, a) for a in ASPECTS)

        return one

    cast = rowwise(make, f"struct<{', '.join(f'{a}: int' for a in ASPECTS)}>")
    gold = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(1 - F.col("quality")).alias("gold_low"), F.max("toxic").alias("gold_toxic")
    )
    voted = docs.select("doc_id", text_key().alias("text_key"), cast(F.col("text").cast("binary")).alias("v"))
    once = voted.select("doc_id", "text_key", "v.*").groupBy("doc_id", "text_key", *ASPECTS).agg(F.count("*").alias("copies"))
    rows = store(once.join(gold, "doc_id", "left").select("doc_id", "text_key", *ASPECTS, "copies", *[f"gold_{a}" for a in ASPECTS]))
    chances, accuracies = {}, {}
    for a in ASPECTS:
        counts = {(r[0], r[1]): r[2] for r in rows.groupBy(a, f"gold_{a}").agg(F.sum("copies")).collect()}
        chances[a], accuracies[a] = estimate(counts, a)
    golds = [F.col(f"gold_{a}").isNull() for a in ASPECTS]  # documents with all gold labels come first
    bare = golds[0] & golds[1]
    without = rows.where(bare).count()
    without = min(without, max(int(sample * UNLABELLED), sample - rows.where(~bare).count()))
    ranked = rows.select("doc_id", "text_key", *ASPECTS, *[f"gold_{a}" for a in ASPECTS]).orderBy(*golds, F.xxhash64("text_key", "doc_id"), "doc_id")
    chosen = ranked.where(~bare).limit(sample - without).unionByName(ranked.where(bare).limit(without))
    features = rowwise(lambda: lambda utf8: np.array(hashed(utf8), np.int32).tobytes(), "binary")
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    picked = F.broadcast(chosen.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key"))  # at most ``sample`` rows
    joined = texts.join(picked, texts["doc_id"].eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).dropDuplicates(["id", "key"])
    taken = joined.select("id", "key", features(F.col("text").cast("binary")).alias("f"), *ASPECTS, *[f"gold_{a}" for a in ASPECTS]).collect()
    taken.sort(key=lambda r: (r["key"], r["id"] is not None, r["id"] or 0))
    drop(rows)
    fitted, features_of = [], [np.frombuffer(r["f"], np.int32) for r in taken]
    for a in ASPECTS:
        targets = np.array([float(r[f"gold_{a}"]) if r[f"gold_{a}"] is not None else chances[a][r[a]] for r in taken])
        certain = np.array([r[f"gold_{a}"] is not None for r in taken])
        fitted.append(fit(features_of, targets, certain, foreign(a)))
    return Scorer(fitted), accuracies


def rating_column(scorer: Scorer, spark):
    """A column function: UTF-8 to the chances of bad."""
    shipped = spark.sparkContext.broadcast([(w.astype(np.float32), b) for w, b in scorer.models])
    return rowwise(lambda: Scorer(shipped.value).rate, f"struct<{', '.join(f'{a}: double' for a in ASPECTS)}>")


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, p_low, p_toxic, kept."""
    scorer, _ = train(docs, labels, sample)
    of = rating_column(scorer, docs.sparkSession)
    rated = docs.select("doc_id", of(F.col("text").cast("binary")).alias("p"))
    return rated.select("doc_id", *[F.col(f"p.{a}").alias(f"p_{a}") for a in ASPECTS]).withColumn("kept", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that stay, with all their columns."""
    scorer, _ = train(docs, labels, sample)
    p = fresh("chances", docs.columns)
    rated = docs.withColumn(p, rating_column(scorer, docs.sparkSession)(F.col("text").cast("binary")))
    return rated.where((F.col(f"{p}.low") < 0.5) & (F.col(f"{p}.toxic") < 0.5)).select(*docs.columns)
