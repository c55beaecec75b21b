"""N-gram Jaccard join by parity sketches.

A set's sketch has a bit for each of m places; a token flips the bit its hash names, so a bit is the
parity of the tokens there. The sketches of two sets differ exactly in the sketch of their symmetric
difference: their Hamming distance never exceeds its size. Sets of sizes a and b with a Jaccard
similarity of p percent or more differ in at most (100 - p)(a + b) / (100 + p) tokens, D.

Candidates come by pigeonhole, one scheme for each size band (a set also joins the next band's scheme
where a partner may lie there). A scheme cuts the places into K > D ranges; D flips leave K - D of them
alike, so two linked sets agree on that many ranges. A range's key is the XOR of its tokens' hashes, the
parity of 2^64 places in one number. A set need not send its poorest ranges: it sends those with at
least t tokens, t being the most that leaves out at most K - D - 1. A range two sets agree on has the
same tokens in both, so the set with the higher t still shares one that both send. No link is lost.

Of the keys and texts, only those that a sieve (a bitmap of hashes, bounded in size) lets through are shuffled
to the join that picks the wanted ones: a fuller sieve lets more through, and the join decides alone.

Buckets of sets that share a key are deduplicated by membership, joined with short folded sketches, and
all their pairs compared in numpy; a bucket above ``bucket_limit`` is dealt into chunks, with a task for
each pair of chunks. What a bucket sends on is a spanning forest of the pairs that pass, never all
pairs. Those are verified on the exact sets. Where a bucket still holds several components after that,
its passing pairs between different components, but for those verified before, are verified as well:
so the components are those of all links, though not every link is looked at. Comparisons (not rows) in
a bucket of many unlinked sets grow with the square of its members.

Defined results: a null or empty text, or one of white space, has the empty set and links with nothing
(``component_id`` is its own doc_id); texts with fewer words than ``words`` have their whole sequence as
one token; rows with equal sets are one node and share a component; repeated rows get a row each; a null doc_id names a component only
if none of its rows has another; an empty table gives an empty result; extra columns are ignored. Tokens are compared as
64-bit hashes; texts are read whole, a megabyte of words at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.common import drop, fresh, rowwise, store, text_key
from ebbgraph.llm.components import connected_components
from ebbgraph.llm.word_pieces import lowering_table, words_by_piece

WORDS = 4
PERCENT = 85
BAND = 1.7  # sizes of a band lie within this ratio
SLACK = 4  # one range more than needed for every so many: room to leave out poor ones
BUCKET_LIMIT = 2048
SKETCH_BITS = 1 << 6, 1 << 15  # least and most
SIEVE_BITS = 1 << 12, 1 << 25  # least and most
SIEVE_SHARE = 16  # places of a sieve for each value in it, while it may grow
LOWER = lowering_table(b"\x09\x0a\x0b\x0c\x0d\x20")
SEED = 42
U = np.uint64
MIX = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values: splitmix64's multipliers
STEP = 0x9E3779B97F4A7C15  # fixed value: splitmix64's increment
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def tokens_of(utf8: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of the whole sequence where it is shorter."""
    digest, parts, tail = xxhash.xxh64_intdigest, [], np.zeros(0, U)

    def grams(hashes: np.ndarray, k: int) -> np.ndarray:
        total = np.full(len(hashes) - k + 1, (k * STEP) & MASK, U)
        for i in range(k):
            total += mix(hashes[i : len(hashes) - k + 1 + i] + U(i * STEP & MASK))
        return mix(total)

    for words in words_by_piece(utf8, LOWER):
        hashes = np.concatenate([tail, np.fromiter((digest(w, SEED) for w in words), U, len(words))])
        if len(hashes) >= n:
            parts.append(np.unique(grams(hashes, n)))
            tail = hashes[len(hashes) - n + 1 :]
        else:
            tail = hashes
    if not parts:
        return grams(tail, len(tail)) if len(tail) else tail
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@lru_cache(maxsize=1)
def band_starts() -> list[int]:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND + 0.5)))
    return starts


def most_apart(a, b, percent: int):
    """The most tokens in which linked sets of these sizes differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def keys_of(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of the ranges that a set sends, in every scheme that it takes part in."""
    size = len(tokens)
    if not size:
        return np.zeros(0, U)
    starts = band_starts()
    own = bisect_right(starts, size) - 1
    out = []
    for band in (own, own + 1):
        if band > own and 100 * size < percent * starts[band]:
            continue
        largest = starts[band + 1] - 1
        apart = most_apart(largest, largest, percent)
        ranges = apart + 1 + apart // SLACK
        place = ((tokens >> U(32)) * U(ranges)) >> U(32)  # ascending, as the tokens are
        ends = np.searchsorted(place, np.arange(ranges + 1, dtype=U))
        counts = np.diff(ends)
        spare = ranges - 1 - min(apart, most_apart(size, min(largest, size * 100 // percent), percent))
        least = np.partition(counts, spare)[spare]
        kept = np.flatnonzero(counts >= least)
        parity = np.zeros(ranges, U)
        full = counts > 0
        parity[full] = np.bitwise_xor.reduceat(mix(tokens + U(STEP)), ends[:-1][full])
        out.append(mix(parity[kept] + mix(kept.astype(U) + U((band + 1) << 40))))
    return np.concatenate(out)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Parity bits as 64-bit words: a power of two of places, about twice the set's size, within SKETCH_BITS."""
    bits = min(max(1 << max(0, 2 * len(tokens) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    parity = np.bincount((mix(tokens ^ U(STEP)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(U)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer places: halves laid on each other, which keeps parities."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def passing(sketches: np.ndarray, sizes: np.ndarray, percent: int, rows: slice) -> np.ndarray:
    """Which of all sets may be linked with each of ``rows``, by sizes and sketches."""
    a, b = sizes[rows, None], sizes[None, :]
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    apart = np.zeros(ok.shape, np.int32)
    for word in sketches.T:
        apart += np.bitwise_count(word[rows, None] ^ word[None, :])
    return ok & (apart <= most_apart(a, b, percent))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) of a breadth-first spanning forest of a symmetric boolean matrix."""
    n = len(near)
    waiting = np.ones(n, bool)
    children, parents = [], []
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = np.array([root])
        while front.size:
            reached = near[front] & waiting
            new = np.flatnonzero(reached.any(axis=0))
            children.append(new)
            parents.append(front[reached[:, new].argmax(axis=0)])
            waiting[new] = False
            front = new
    return np.concatenate(children), np.concatenate(parents)


def _compare(buckets: DataFrame, percent: int, across: bool) -> DataFrame:
    """Rows (key, pair, node, n, root, sketch) in order of (key, pair) to candidate pairs (a, b).

    A spanning forest of what passes in each bucket, or, ``across`` components, all passing pairs of different roots.
    """

    def candidates(node, size, root, sketches) -> tuple[np.ndarray, np.ndarray]:
        words = min(map(len, sketches))
        matrix = np.stack([folded(s, words) for s in sketches])
        near = np.concatenate([passing(matrix, size, percent, slice(i, i + 256)) for i in range(0, len(size), 256)])
        if across:
            near &= root[:, None] != root[None, :]
            a, b = np.nonzero(np.triu(near, 1))
        else:
            np.fill_diagonal(near, False)
            a, b = forest(near)
        return node[a], node[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        current = None

        def done() -> pa.RecordBatch:
            node, size, root = (np.concatenate(h) for h in held[:3])
            a, b = candidates(node, size, root, held[3]) if len(node) > 1 else (node[:0], node[:0])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, pair, node, size, root = (batch.column(i).to_numpy() for i in range(5))
            lists = batch.column(5)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
                if current is not None and current != (key[start], pair[start]):
                    yield done()
                    held = [[], [], [], []]
                current = key[start], pair[start]
                for h, column in zip(held, (node, size, root)):
                    h.append(column[start:stop])
                held[3].extend(flat[ends[i] : ends[i + 1]] for i in range(start, stop))
        if current is not None:
            yield done()

    return buckets.mapInArrow(run, "a long, b long").distinct()


def _dealt(members: DataFrame, limit: int) -> DataFrame:
    """Members with the pairs of chunks that they belong to; a bucket within the limit is one pair."""
    chunks = F.when(F.col("c") <= limit, F.lit(1)).otherwise(F.ceil(2 * F.col("c") / limit)).cast("long")
    mine = F.pmod(F.xxhash64("node", "key"), chunks)
    dealt = members.select("*", chunks.alias("chunks"), mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    return dealt.select(
        "key", (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")).alias("pair"), "node", "root"
    )


def _candidates(members: DataFrame, nodes: DataFrame, percent: int, limit: int, across: bool) -> DataFrame:
    rows = _dealt(members, limit).join(nodes.select("node", F.col("n").cast("long").alias("n"), "sketch").hint("merge"), "node")
    ordered = rows.select("key", "pair", "node", "n", "root", "sketch").repartition("key", "pair").sortWithinPartitions("key", "pair")
    return _compare(ordered, percent, across)


def _sifted(rows: DataFrame, hashed: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose ``hashed`` may be in ``wanted`` (a column of hashes): all that are, and few others.

    Meant before a join, so that rows without a partner are not shuffled. The bitmap is broadcast; its size is bounded.
    """
    bits = min(max(1 << (SIEVE_SHARE * wanted.count()).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])

    def place(value: Column) -> tuple[Column, Column]:
        at = value.bitwiseAND(F.lit(bits - 1))
        return F.floor(at / 64).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(F.col(wanted.columns[0]))
    marks = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("marks"))
    blank = wanted.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("marks"))
    words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("marks").alias("marks"))
    name = fresh("sieve", rows.columns)
    sieve = words.agg(F.sort_array(F.collect_list(F.struct("word", "marks")))["marks"].alias(name))
    word, bit = place(hashed)
    return rows.join(F.broadcast(sieve), F.getbit(F.get(name, word), bit) == 1).select(*rows.columns)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets are alike enough, counted on the sets themselves (made anew from the texts)."""
    of = rowwise(lambda: lambda utf8: tokens_of(utf8, words).view(np.int64), "array<bigint>")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = store(ends.join(nodes.select("node", "rep.rep_doc", "rep.rep_key"), "node"))
    sifted = _sifted(docs, F.xxhash64("doc_id", text_key()), wanted.select(F.xxhash64("rep_doc", "rep_key")))
    texts = sifted.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (text_key() == F.col("rep_key"))).dropDuplicates(["node"])
    sets = store(texts.select("node", of(F.col("text").cast("binary")).alias("tokens")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    common = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("i"), (F.size("ta") + F.size("tb")).cast("long").alias("s"))
    done = store(common.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"))
    drop(sets, wanted)
    return done


def _components(*links: DataFrame) -> DataFrame:
    """node, root over the links' nodes; roots are hashes (one-to-one, in pseudo-random order)."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    found = connected_components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    return found.select(F.col("node").alias("hashed"), "root")


def _rooted(nodes: DataFrame, components: DataFrame) -> DataFrame:
    hashed = nodes.withColumn("hashed", F.xxhash64("node"))
    return hashed.join(components, "hashed", "left").withColumn("root", F.coalesce("root", "hashed")).drop("hashed")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles (set size), component_id (the smallest doc_id that links reach)."""
    docs = docs.select("doc_id", "text")

    def make():
        def one(utf8):
            tokens = tokens_of(utf8, words)
            raw = tokens.tobytes()
            h = [xxhash.xxh64_intdigest(raw, seed) for seed in (1, 2)]
            h1, h2 = (x - (1 << 64) if x >> 63 else x for x in h)
            return len(tokens), h1, h2, keys_of(tokens, percent).view(np.int64), sketch_of(tokens).view(np.int64)

        return one

    of = rowwise(make, "struct<n: bigint, h1: bigint, h2: bigint, keys: array<bigint>, sketch: array<bigint>>")
    whole = store(docs.select("doc_id", text_key().alias("text_key"), of(F.col("text").cast("binary")).alias("set")).select("doc_id", "text_key", "set.*"))
    representative = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("rep_doc"), F.col("text_key").alias("rep_key"))
    grouped = whole.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min(representative).alias("rep"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")
    )
    keyed = store(grouped.withColumn("node", F.monotonically_increasing_id()))
    nodes, rows = store(keyed.drop("keys")), store(whole.drop("keys", "sketch"))
    drop(whole)

    ranges = keyed.select("node", F.explode("keys").alias("key"))
    # nearly all keys have one row: without a partial aggregate, rows of two numbers are shuffled in place of five
    shared = ranges.repartition("key").groupBy("key").agg(
        F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("who")
    ).where("low < high")
    buckets = store(shared.groupBy("c", "low", "high", "who").agg(F.min("key").alias("key")))  # one of those with the same members
    of_two = buckets.where("c = 2").select("key", "c", F.explode(F.array("low", "high")).alias("node"))
    of_more = buckets.where("c > 2").select("key", "c")
    large = store(_sifted(ranges, F.col("key"), of_more.select("key")).join(of_more.hint("merge"), "key").select("key", "c", "node"))
    drop(keyed)
    no_root = F.lit(0).cast("long").alias("root")
    members = of_two.unionByName(large).select("key", "c", "node", no_root)

    first = store(_candidates(members, nodes, percent, bucket_limit, across=False))
    links = _verified(first, nodes, docs, words, percent)
    found = _components(links)
    placed = large.join(_rooted(nodes.select("node"), found), "node")
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    open_members = placed.join(split.select("key"), "key")
    second = store(_candidates(open_members, nodes, percent, bucket_limit, across=True).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        found = _components(links, _verified(second, nodes, docs, words, percent))

    rooted = _rooted(nodes.select("node", "n", "h1", "h2", "rep"), found)
    named = rooted.groupBy("root").agg(F.min("rep").alias("best"))
    component = store(rooted.join(named, "root").select("n", "h1", "h2", F.col("best.rep_doc").alias("component_id")))
    joined = rows.join(component, ["n", "h1", "h2"], "left")
    return joined.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
