"""Line deduplication by winnowing.

A text's lines that hold words are hashed. A window starts at each of them and takes as many lines as
make ``least_words`` words; of every window the line with the smallest hash is selected as fingerprint.
Equal windows select the same line, so any run of whole lines with that many words that occurs twice
shares a fingerprint: none can be missed. Fingerprints that occur at one place only are dropped
(counted with partial aggregation); the positions of the others are joined to the first place of the
same window, in order of doc_id and line, never pair by pair. Windows that match and overlap or touch are
deleted as one.

So a line goes exactly if it lies in a window whose content starts at an earlier place of the corpus. The
first place keeps its lines, and blank lines inside a deleted run go with it. By this rule the last lines of
a repeated run stay if they hold under ``least_words`` words after a longer line: no window reaches them.

With ``whole_runs`` they go too: a line goes exactly if it lies in a run of lines with ``least_words`` words
that occurs at an earlier place, first or not, so every maximal run goes from its first line to its last.
For that a window also ends at each line, and goes back over as many lines as make ``least_words`` words. A
repeated run around a line can be shortened at both ends as long as it keeps the line and enough words; what
is left starts a window or ends one (blank lines between two lines that are windows by themselves go with
the window of both). So the two kinds of windows extend every match both ways, and no
document's lines are joined to its source's.

Defined results: a null text counts as empty (no lines are deleted, the text stays null); texts with fewer
than ``least_words`` words lose nothing; lines are compared without white space at their ends; a null
doc_id comes first in order; rows with equal doc_id and equal text are one document, and each such row
gets the same result; an empty table gives an empty result; extra columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import drop, fresh, rowwise, store, text_key

LEAST_WORDS = 50


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def windows(utf8: bytes | None, least_words: int = LEAST_WORDS, whole_runs: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(hash of the selected line, its number, hash of the window, first and last line number) of every window.

    ``whole_runs``: also of the windows that end at a line, where no window that starts is the same, and of
    neighbouring lines that are windows by themselves.
    """
    numbers, hashes, words = [], [], []
    for at, line in enumerate((utf8 or b"").split(b"\n")):
        n = len(line.split())
        if n:
            numbers.append(at)
            hashes.append(xxhash.xxh64_intdigest(line.strip()))
            words.append(n)
    packed = np.array(hashes, np.uint64).tobytes()
    out, least, end, total = [], deque(), 0, 0  # ``least``: rising hashes of the window, its smallest in front
    for start in range(len(numbers)):
        while total < least_words and end < len(numbers):
            total += words[end]
            while least and hashes[least[-1]] > hashes[end]:
                least.pop()
            least.append(end)
            end += 1
        if total < least_words:
            break
        at = least[0]
        content = xxhash.xxh64_intdigest(packed[8 * start : 8 * end], end - start)
        out.append((_signed(hashes[at]), numbers[at], _signed(content), numbers[start], numbers[end - 1]))
        total -= words[start]
        if least[0] == start:
            least.popleft()
    if not whole_runs:
        return out
    least, start, total = deque(), 0, 0
    for end in range(len(numbers)):
        total += words[end]
        while least and hashes[least[-1]] > hashes[end]:
            least.pop()
        least.append(end)
        while total - words[start] >= least_words:
            total -= words[start]
            if least[0] == start:
                least.popleft()
            start += 1
        if total - words[end] >= least_words:
            first, at = start, least[0]
        elif end and min(words[end - 1], words[end]) >= least_words:  # for the blank lines between
            first, at = end - 1, end - 1 if hashes[end - 1] <= hashes[end] else end
        else:  # too short, or also the window that starts there
            continue
        content = xxhash.xxh64_intdigest(packed[8 * first : 8 * (end + 1)], end + 1 - first)
        out.append((_signed(hashes[at]), numbers[at], _signed(content), numbers[first], numbers[end]))
    return out


def extended(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Matching windows that overlap or touch, as one run."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def repeated_windows(docs: DataFrame, least_words: int = LEAST_WORDS, whole_runs: bool = False) -> DataFrame:
    """doc_id, text_key, runs: for documents with windows that occur earlier, their (first, last) lines."""
    kind = "array<struct<selected: bigint, at: int, content: bigint, first: int, last: int>>"
    cut = rowwise(lambda: lambda utf8: windows(utf8, least_words, whole_runs), kind)
    all_ = docs.select("doc_id", text_key().alias("text_key"), F.explode(cut(F.col("text").cast("binary"))).alias("w"))
    placed = store(all_.select("doc_id", "text_key", "w.*"))
    place = F.xxhash64("doc_id", "text_key", "at")
    shared = store(
        placed.groupBy("selected").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("selected")
    )
    joined = placed.join(shared, "selected", "left_semi")
    start = F.struct("doc_id", "text_key", "first")
    firsts = joined.groupBy("selected", "content").agg(F.min(start).alias("source"))
    later = joined.join(firsts, ["selected", "content"]).where(~F.col("source").eqNullSafe(start))
    runs = store(later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    drop(placed, shared)
    return runs


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, whole_runs: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``; adds n_lines and n_deleted.

    A column that ``docs`` has under one of these two names, in any case of letters, is replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    docs = docs.select(*kept)
    taken = [*docs.columns, "n_lines", "n_deleted"]
    id_, key, runs, out = (fresh(x, taken) for x in ("run_doc", "run_key", "runs", "shortened"))
    found = repeated_windows(docs, least_words, whole_runs).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("runs").alias(runs))
    # the same plan at every size: at full size neither side can be broadcast
    joined = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & (text_key() == F.col(key)), "left")

    def make():
        def one(row):
            if row is None:
                return None
            lines, gone = row["text"].split("\n"), 0
            for first, last in reversed(extended([(r["first"], r["last"]) for r in row["runs"]])):
                del lines[first : last + 1]
                gone += last + 1 - first
            return "\n".join(lines), gone

        return one

    shorten = rowwise(make, "struct<text: string, gone: int>")
    given = F.when(F.col(runs).isNotNull(), F.struct(F.col("text").alias("text"), F.col(runs).alias("runs")))
    done = joined.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")).withColumn(out, shorten(given))
    return done.withColumns({
        "text": F.when(F.col(out).isNull(), F.col("text")).otherwise(F.col(f"{out}.text")),
        "n_deleted": F.coalesce(F.col(f"{out}.gone"), F.lit(0)).cast("long"),
    }).select(*kept, "n_lines", "n_deleted")
