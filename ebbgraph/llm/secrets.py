"""Secret scans in DataFrame operations only: fixed patterns, and Markov models of random and ordinary strings.

One scan of the texts gives the spans of the fixed patterns and the positions of long tokens, as small
arrays that are stored. Character pairs are then counted over all tokens: the model of random strings
from the values that the fixed patterns caught and from generated random strings, the model of
ordinary identifiers from all other tokens (callers may give labelled samples of their own instead).
The counts are as many as the alphabet's pairs, whatever the corpus. A token is a secret if the log of
its likelihood ratio, summed over its character pairs, exceeds ``threshold``.

Positions come from splitting a text at its matches and adding up lengths. That sum runs once for
each match over the matches before it, so it is quadratic in the matches of one text, not in its length.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive;
added spans never overlap fixed ones; ties in start are ordered by kind as listed; rows are independent
but for the model, so repeats and null ids each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import store, text_or_empty

#: The base patterns. A failing match takes up text, so the length of an assigned value is judged after matching.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters in all; a shorter run can hold no longer match
HEX = r"[0-9a-f]{32,}"  # whole runs, as matching is greedy
ASSIGN_CHARS = 8

TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
GENERATED = 20_000  # random strings of each form in the training sample
THRESHOLD = 14.0  # log of the odds that a token must overcome: about a million to one
SMOOTHING = 0.5


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) for all matches; ``value`` is the match, or its group 1 if asked for."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    kind = "array<struct<start: int, end: int, value: string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    spans = F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(F.aggregate(pairs, begin, step)["out"])
    if group:
        return F.transform(
            spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["value"], pattern, group).alias("value"))
        )
    return spans


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the three fixed kinds, tokens: arrays of (start, end, value), for every row."""
    text = text_or_empty()
    found = docs.select(
        "doc_id", located(text, ASSIGN, 1).alias("assign"), located(text, ACCESS).alias("access"),
        located(text, HEX).alias("hex"), located(text, TOKEN).alias("tokens"),
    )
    long_enough = F.filter("assign", lambda m: F.length(m["value"]) >= ASSIGN_CHARS)
    fixed = found.withColumn("assign", long_enough)
    base = F.concat("assign", "access", "hex")
    apart = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return fixed.withColumn("tokens", apart)


def generated_samples(spark, n: int = GENERATED) -> DataFrame:
    """value: random strings of mixed, upper-case and hexadecimal form, from hashes of numbers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(
        F.explode(F.array(
            F.translate(F.base64(F.unhex(digest)), "=", ""), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), F.substring(digest, 1, 40)
        )).alias("value")
    )


def pair_counts(samples: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of alphabet positions follows one another in column ``value``; at most the alphabet squared."""
    at = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = samples.where(F.length("value") > 1).select(F.explode(F.transform(at, lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    alphabet = F.lit(ALPHABET)
    return {
        (r["pair"][0], r["pair"][1]): r["count"]
        for r in pairs.groupBy("pair").count().where(
            (F.instr(alphabet, F.substring("pair", 1, 1)) > 0) & (F.instr(alphabet, F.substring("pair", 2, 1)) > 0)
        ).collect()
    }


def log_ratios(random: dict, ordinary: dict) -> list[float]:
    """For each pair (first * (n + 1) + second, positions from 1): log P(second | first, random) / P(second | first, ordinary)."""
    n = len(ALPHABET)
    out = [0.0] * (n + 1) ** 2
    for i, a in enumerate(ALPHABET, 1):
        totals = [sum(model.get((a, b), 0) for b in ALPHABET) + SMOOTHING * n for model in (random, ordinary)]
        for j, b in enumerate(ALPHABET, 1):
            p, q = ((model.get((a, b), 0) + SMOOTHING) / total for model, total in zip((random, ordinary), totals))
            out[i * (n + 1) + j] = round(math.log(p / q), 6)
    return out


def log_likelihood_ratio(value: Column, ratios: list[float]) -> Column:
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    alphabet = F.lit(ALPHABET)

    def step(acc: Column, i: Column) -> Column:
        first, second = (F.call_function("instr", alphabet, F.substring(value, k, F.lit(1))) for k in (i, i + 1))
        return acc + F.element_at(table, first * n + second + 1)

    return F.when(F.length(value) < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), step))


def mixed(value: Column) -> Column:
    """Letters of both cases, or letters and digits: plain words and plain numbers are no secrets."""
    lower, upper, digit = (value.rlike(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return (lower & upper) | (lower & digit) | (upper & digit)


def find_secrets(docs: DataFrame, random: DataFrame | None = None, ordinary: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, spans: array of (start, kind, end) in order, kind an index of ``KINDS``.

    ``random`` and ``ordinary``: labelled samples, column ``value``; by default from the corpus and generated.
    """
    found = store(scan(docs))
    others = found.select(F.explode("tokens").alias("m")).select("m.value")
    if random is None:
        caught = found.select(F.explode(F.concat("assign", "access", "hex")).alias("m")).select("m.value")
        random = caught.unionByName(generated_samples(docs.sparkSession))
    of_random = pair_counts(random)
    ratios = log_ratios(of_random, pair_counts(others if ordinary is None else ordinary))
    if ordinary is None:  # once more without the tokens that the first model holds for random
        value = F.col("value")
        ratios = log_ratios(of_random, pair_counts(others.where(~mixed(value) | (log_likelihood_ratio(value, ratios) <= 0))))
    secret = F.filter("tokens", lambda t: mixed(t["value"]) & (log_likelihood_ratio(t["value"], ratios) > threshold))
    kinds = (F.col("assign"), F.col("access"), F.col("hex"), secret)
    spans = [_of_kind(k, matches) for k, matches in enumerate(kinds)]
    return found.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def _of_kind(kind: int, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def count_of_kind(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
