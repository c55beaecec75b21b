"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages, one pass over each text.

The automaton's alphabet is words: a text is normalised to words (bytes, A-Z lower-cased), words map
to ids of the benchmark's vocabulary, and the id sequence runs through the automaton once. A hit's
word positions are mapped back to character offsets of the original text for the span output.

The benchmark is small against the corpus, but its size is checked: its words are counted by Spark,
and the automaton holds at most ``block_words`` of them (and at most ``block_words * window`` trie
nodes). A larger benchmark is cut into blocks of items, each a pass of its own that adds to the
words and items already found; the rows with their marks are stored between passes, so one worker
holds one automaton. An item longer than a block is cut into overlapping parts, so no window is lost.

Defined results: a null or empty text has no words and no hits; a null item text is no item; a null
item_id is left out of the item list; repeated benchmark rows count once; repeated documents each
get their row; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import fresh, rowwise, store

WINDOW = 13
BLOCK_WORDS = 200_000

#: Word characters are digits, letters (A-Z lower-cased) and everything beyond ASCII.
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(utf8: bytes | None) -> list[bytes]:
    return utf8.translate(TO_WORDS).split() if utf8 else []


def benchmark_parts(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """item_id, words: every item's words, long items in parts that overlap by ``window - 1`` words."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    items = benchmark.where("text is not null").select("item_id", words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(block_words))
    parts = items.select("item_id", "words", F.explode(starts).alias("start"))
    return parts.select("item_id", F.slice("words", F.col("start") + 1, F.lit(block_words + window - 1)).alias("words")).distinct()


class Passages:
    """The automaton of one block of items and what it finds in a text."""

    def __init__(self, items: Sequence[tuple[int | None, Sequence[str]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words]
            for start in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[start : start + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(found)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, last word, items) of every occurrence of a window."""
        if words and not self.empty:
            ids = tuple(map(self.vocabulary.get, words, repeat(0)))
            for last, (length, items) in self.automaton.iter(ids):
                yield last - length + 1, last, items


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching runs of words as one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _scan(items: list, window: int, spark, last: bool):
    """A column function: (utf8, runs, items) to what one automaton adds; the last one also gives counts and spans."""
    shipped = spark.sparkContext.broadcast(items)

    def make():
        passages = Passages(shipped.value, window)

        def one(row):
            words = words_of(row["utf8"])
            runs, found = list(row["runs"] or ()), set(row["items"] or ())
            for first, end, owners in passages.find(words):
                found.update(x for x in owners if x is not None)
                runs.append([first, end])
            runs = merged(runs)
            if not last:
                return runs, sorted(found)
            at = [m.span() for m in WORD.finditer(row["utf8"].decode())] if runs else ()
            return len(words), sum(b - a + 1 for a, b in runs), sorted(found), [[at[a][0], at[b][1]] for a, b in runs]

        return one

    counts = "n_words: bigint, n_hit: bigint, items: array<bigint>, spans: array<array<int>>"
    return rowwise(make, f"struct<{counts if last else 'runs: array<array<int>>, items: array<bigint>'}>")


def with_contamination(
    docs: DataFrame, benchmark: DataFrame, into: str, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items (sorted ids), spans (characters of the hit text)."""
    if block_words < window:
        raise ValueError("block_words must be at least the window")
    parts = store(benchmark_parts(benchmark, window, block_words))
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    so_far = fresh("found", [*docs.columns, into])
    nothing = "struct<runs: array<array<int>>, items: array<bigint>>"
    rows = docs.withColumn(so_far, F.lit(None).cast(nothing))
    state = F.struct(F.col("text").cast("binary").alias("utf8"), F.col(f"{so_far}.runs"), F.col(f"{so_far}.items"))
    for block in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block)
        last = block + 1 == blocks
        scan = _scan([(r[0], r[1]) for r in mine.collect()], window, docs.sparkSession, last)
        rows = rows.withColumn(into if last else so_far, scan(state))
        if not last:
            rows = store(rows)
    return rows.drop(so_far)


def is_contaminated(found: str) -> Column:
    """At least a twentieth of the words, and at least one, lie in benchmark passages."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items, spans, contaminated."""
    found = with_contamination(docs.select("doc_id", "text"), benchmark, "found", **options)
    return found.select("doc_id", "found.*").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    into = fresh("contamination", docs.columns)
    return with_contamination(docs, benchmark, into, **options).where(~is_contaminated(into)).select(*docs.columns)
