"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Fingerprints within ``radius`` bits agree in at least one of ``radius + 1`` equal blocks of bits, so
every distinct fingerprint goes to one shard per block, named by the block's value: no link can be
missed. Each shard is a BK-tree. Trees reach the tasks through the shuffle, not through a broadcast:
all shard trees together grow with the corpus, and a query's matches can only lie in its own shards.
A shard above ``tree_limit`` fingerprints is dealt into chunks, and a tree is built for every pair of
chunks, so a tree stays bounded and a dense shard spreads over many tasks. A tree gives one row per
fingerprint (to the first of its group), never all pairs; components are contracted on Spark.

``similar_groups`` finds the pairs whose word shingles have a Jaccard similarity of ``percent`` or more.
Such pairs lie too many bits apart for blocks of 64 bits, so a document's shards are named by ``KEYS``
triples of min-hashes of its shingles instead: a pair of similarity s shares a shard with a probability
of 1 - (1 - s^3)^KEYS (0.996 at 0.8). In a shard a BK-tree of the fingerprints is searched within
``WIDE_RADIUS`` bits; pairs whose parities show that they differ too much go, and the rest is confirmed by counting the shingles in common. A tree sends a
spanning forest of its closest matches; where a shard still holds several components after those are
counted, the matches between different ones are counted too. A shard of many documents that are within
the radius, but not similar enough, so costs comparisons that grow with the square of its members.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows each get their row in ``near_duplicates``; a null doc_id is never a component's name unless all
its documents have none; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``near_dedup``. In ``similar_groups`` rows with equal shingle sets (all
empty texts: the empty set) are one group; texts with fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbgraph.llm.bktree import BKForest
from ebbgraph.llm.common import keep_marked, rowwise, store, text_key
from ebbgraph.llm.components import connected_components
from ebbgraph.llm.parity_join import _components, _dealt, _rooted, _verified, mix, most_apart, tokens_of

SHINGLE_WORDS = 3
RADIUS = 3
TREE_LIMIT = 4096
BLOCK_HASHES = 1 << 15  # hashes whose bits are counted together
SIMILAR_WORDS, SIMILAR_PERCENT = 5, 80
WIDE_RADIUS = 16
WIDE_TREE_LIMIT = 1024  # a wide search meets most of a tree
KEYS, TRIPLE = 8, 3  # shards of a document, min-hashes that name one
PARITY_WORDS = 16  # 64-bit words of parities
MULTIPLIERS = mix(np.arange(1, KEYS * TRIPLE + 1, dtype=np.uint64)) | np.uint64(1)


def fingerprint(utf8: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text as a signed integer: a bit is set if over half the shingles' hashes set it."""
    words = (utf8 or b"").lower().split()  # for bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - n + 1)
    if len(words) <= n:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(n)]))
    ones = np.zeros(64, np.int64)
    left = count
    while left:
        part = min(left, BLOCK_HASHES)
        hashes = np.fromiter((digest(next(shingles), 42) for _ in range(part)), np.uint64, part)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(part, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= part
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, fingerprint (long) of every row; stored, as Python makes it."""
    of = rowwise(lambda: lambda utf8: fingerprint(utf8, n), "bigint")
    return store(docs.select("doc_id", text_key().alias("text_key"), of(F.col("text").cast("binary")).alias("fingerprint")))


def _links(shards: DataFrame, radius: int) -> DataFrame:
    """Rows (shard, pair, fingerprint) to links (x, y): each fingerprint to the first of its group in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(shard, pair, value) -> pa.RecordBatch:
            new = np.r_[True, (shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])] if len(shard) else np.zeros(0, bool)
            first = BKForest(value.view(np.uint64), np.cumsum(new)).groups(radius)
            other = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays([pa.array(value[other]), pa.array(value[first[other]])], names=["x", "y"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            held.append(rows)
            if sum(h.shape[1] for h in held) < 1 << 16 and len(held) < 64:
                continue
            rows = np.concatenate(held, axis=1)
            ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last tree may go on in the next batch
            if cut:
                yield linked(*rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield linked(*np.concatenate(held, axis=1))

    return shards.mapInArrow(run, "x long, y long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Links (x, y) that connect all distinct fingerprints within ``radius`` bits of each other."""
    blocks = radius + 1
    width, value = 64 // blocks, F.col("fingerprint")
    mask = (1 << width) - 1
    shard = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask)) * blocks + i for i in range(blocks)]
    keyed = distinct.select("fingerprint", F.explode(F.array(*shard)).alias("shard"))
    large = store(
        keyed.groupBy("shard").count().where(F.col("count") > tree_limit)
        .select("shard", F.ceil(2 * F.col("count") / tree_limit).cast("long").alias("chunks"))
    )
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fingerprint", "shard"), chunks)
    partners = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    dealt = keyed.join(large, "shard", "left").select("shard", "fingerprint", chunks.alias("chunks"), mine.alias("mine"), partners.alias("other"))
    pair = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")
    trees = dealt.select("shard", pair.alias("pair"), "fingerprint").repartition("shard", "pair")
    return _links(trees.sortWithinPartitions("shard", "pair", "fingerprint"), radius)


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Per row: doc_id, text_key, fingerprint (long), component_id (the smallest doc_id that links reach), root (a component's own number).

    """
    rows = fingerprints(docs, n)
    distinct = store(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct.select("fingerprint"), radius, tree_limit)
    # the hash of a long is one-to-one: it only puts the nodes in a pseudo-random order
    names = F.xxhash64("fingerprint").alias("node")
    roots = connected_components(links.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")))
    rooted = distinct.select("fingerprint", "least", names).join(roots, "node", "left").select(
        "fingerprint", "least", F.coalesce("root", "node").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = store(rooted.join(named, "root").select("fingerprint", "root", "component_id"))
    return rows.join(component, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id", "root")


def shard_keys(tokens: np.ndarray) -> np.ndarray:
    """Names of the shards of a set of hashes: each from a triple of min-hashes."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for start in range(0, len(tokens), BLOCK_HASHES):
        part = tokens[start : start + BLOCK_HASHES]
        least = np.minimum(least, [(part * m).min() for m in MULTIPLIERS])
    triples = mix(least).reshape(KEYS, TRIPLE) * MULTIPLIERS[:TRIPLE]
    return mix(triples.sum(axis=1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one bit: two sets differ in at least as many tokens as their parities differ in bits."""
    bits = np.bincount((mix(tokens) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def closest_forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a minimum spanning forest over nodes 0 to n - 1: every component takes its closest pair, until none is left."""
    order = np.argsort(apart, kind="stable")
    a, b, label = a[order], b[order], np.arange(n)
    picked_a, picked_b = [a[:0]], [b[:0]]
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not a.size:
            return np.concatenate(picked_a), np.concatenate(picked_b)
        place, best = np.arange(len(a)), np.full(n, len(a))
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        pick = np.unique(best[best < len(a)])
        picked_a.append(a[pick])
        picked_b.append(b[pick])
        x, y = la[pick], lb[pick]
        while True:
            low = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            label = label[label]
            if (label == before).all():
                break


def _tree_matches(trees: DataFrame, radius: int, percent: int, across: bool) -> DataFrame:
    """Rows (shard, pair, node, n, root, fingerprint, parities) in order of trees to candidate pairs (a, b) of nodes.

    A forest of the closest matches in each tree, or, ``across`` components, all matches of different roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def matches(shard, pair, node, size, root, value, *words) -> pa.RecordBatch:
            new = np.r_[True, (shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])] if len(shard) else np.zeros(0, bool)
            value = value.view(np.uint64)
            words = [w.view(np.uint64) for w in words]
            a, b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for x, y in BKForest(value, np.cumsum(new)).near(radius):
                fits = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
                if across:
                    fits &= root[x] != root[y]
                x, y = x[fits], y[fits]
                flips = sum((np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words), np.zeros(len(x), np.int64))
                fits = flips <= most_apart(size[x], size[y], percent)
                a.append(x[fits].astype(np.int32))
                b.append(y[fits].astype(np.int32))
            x, y = np.concatenate(a), np.concatenate(b)
            if not across:
                x, y = closest_forest(x, y, np.bitwise_count(value[x] ^ value[y]), len(value))
            ends = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(6).flatten().to_numpy().reshape(-1, PARITY_WORDS).T
            held.append(np.concatenate([np.stack([c.to_numpy() for c in batch.columns[:6]]), words]))
            if sum(h.shape[1] for h in held) < 2 * WIDE_TREE_LIMIT:
                continue
            rows = np.concatenate(held, axis=1)
            ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            start = 0
            while len(ends) and ends[-1] > start:  # whole trees, a few thousand rows at a time
                fit = ends[ends <= start + 4 * WIDE_TREE_LIMIT]
                stop = int(fit[-1]) if len(fit) and fit[-1] > start else int(ends[ends > start][0])
                yield matches(*rows[:, start:stop])
                start = stop
            held = [rows[:, start:]]  # the last tree may go on in the next batch
        if held:
            yield matches(*np.concatenate(held, axis=1))

    return trees.mapInArrow(run, "a long, b long").distinct()


def similar_groups(
    docs: DataFrame, words: int = SIMILAR_WORDS, percent: int = SIMILAR_PERCENT, radius: int = WIDE_RADIUS, tree_limit: int = WIDE_TREE_LIMIT
) -> DataFrame:
    """Per row: doc_id, text_key, root (a group's own number); groups are linked by similar pairs."""
    docs = docs.select("doc_id", "text")

    def make():
        def one(utf8):
            tokens = tokens_of(utf8, words)
            raw = tokens.tobytes()
            h1, h2 = (x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(raw, seed) for seed in (1, 2)))
            return len(tokens), h1, h2, fingerprint(utf8), shard_keys(tokens).view(np.int64), parities(tokens).view(np.int64)

        return one

    of = rowwise(make, "struct<n: bigint, h1: bigint, h2: bigint, fingerprint: bigint, keys: array<bigint>, parities: array<bigint>>")
    rows = store(docs.select("doc_id", text_key().alias("text_key"), of(F.col("text").cast("binary")).alias("set")).select("doc_id", "text_key", "set.*"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("rep_doc"), F.col("text_key").alias("rep_key"))
    grouped = rows.groupBy("n", "h1", "h2").agg(F.min(first).alias("rep"), F.min("fingerprint").alias("fingerprint"), F.any_value("keys").alias("keys"), F.any_value("parities").alias("parities"))
    nodes = store(grouped.withColumn("node", F.monotonically_increasing_id()))

    named = nodes.select("node", F.explode("keys").alias("key"))
    shared = named.groupBy("key").agg(
        F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("who")
    ).where("low < high")
    shards = store(shared.groupBy("c", "low", "high", "who").agg(F.min("key").alias("key")))  # one of those with the same members
    members = store(named.join(shards.select("key", "c").hint("merge"), "key").select("key", "c", "node"))

    def matches(held: DataFrame, across: bool) -> DataFrame:
        dealt = _dealt(held, tree_limit).join(nodes.select("node", "n", "fingerprint", "parities").hint("merge"), "node")
        trees = dealt.select(F.col("key").alias("shard"), "pair", "node", "n", "root", "fingerprint", "parities").repartition("shard", "pair")
        return _tree_matches(trees.sortWithinPartitions("shard", "pair", "fingerprint"), radius, percent, across)

    forest = store(matches(members.withColumn("root", F.lit(0).cast("long")), across=False))
    links = _verified(forest, nodes, docs, words, percent)
    found = _components(links)
    placed = members.join(_rooted(nodes.select("node"), found), "node")
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    more = store(matches(placed.join(split.select("key"), "key").select("key", "c", "node", "root"), across=True).join(forest, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = _components(links, _verified(more, nodes, docs, words, percent))
    rooted = store(_rooted(nodes.select("node", "n", "h1", "h2"), found).select("n", "h1", "h2", "root"))
    return rows.select("doc_id", "text_key", "n", "h1", "h2").join(rooted, ["n", "h1", "h2"]).select("doc_id", "text_key", "root")


def near_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each component of ``near_duplicates``, with all its columns: the smallest doc_id (then text_key), one copy of it."""
    return _first_of_each(docs, near_duplicates(docs, **options))


def similar_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each of the ``similar_groups``, with all its columns: the smallest doc_id (then text_key), one copy of it."""
    return _first_of_each(docs, similar_groups(docs, **options))


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    rows = store(found.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("copies")))
    best = rows.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")
    )
    joined = rows.join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marks = joined.select("doc_id", "text_key", (~stays).alias("dropped"), "copies").where("dropped or copies > 1")
    return keep_marked(docs, store(marks))
