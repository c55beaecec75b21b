import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import roots

from ebbgraph.llm import lexical, merkle, parity_join, word_pieces

ODD = "doc_id long, text string, source string, lang string, n_chars long, n long, `tree` int, rank string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 3, 7, 1, "r") for i, t, s in rows], ODD).repartition(4)


# --- ranked search ---------------------------------------------------------------


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def naive_rank(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(x for _, c in counted for x in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


RND = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["É", "straße", "naïve", "42"]
DOCS = [(i, " ".join(RND.choice(VOCABULARY[: RND.randrange(3, 64)]) for _ in range(RND.randrange(1, 90)))) for i in range(120)]
DOCS += [(200, None), (201, ""), (202, " .,\n"), (None, "w1 w2 w3"), (203, "W1;w2--W3"), (203, "w1 w2 w3"), (203, "w1 w2 w3"), (204, "straße " * 300_000)]
ITEMS = [(1, "w1 w2 É"), (2, None), (3, ""), (4, "nowhere"), (None, "w3 straße"), (5, "w1 " * 30), (5, "w7"), (6, " ".join(VOCABULARY)), (7, "STRASSE straße É é")]


@pytest.mark.parametrize("options", [{}, {"k": 3, "block_terms": 20}])
def test_ranking_equals_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(word_pieces, "PIECE", 1 << 16)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = lexical.rank(odd(spark, [(i, t, "s") for i, t in DOCS]), items, **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == naive_rank(DOCS, ITEMS, options.get("k", 10))


def test_ranking_of_empty_tables(spark):
    docs, items = odd(spark, [(1, "a b", "s")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.where("false"), items).count() == 0
    assert lexical.rank(docs, items.where("false")).count() == 0
    assert lexical.rank(odd(spark, [(1, None, "s")]), items).count() == 0


def test_tiles_are_exact_and_keep_ties():
    weights = np.full(5000, 26_000)
    tile = lexical.Tile([(0, list(range(5000))), (1, [4999])], weights, 700)
    assert all(m.shape[1] * 26_000 * lexical.IMPACT_LIMIT < lexical.EXACT for m, _ in tile.segments) and len(tile.segments) == 8
    term = np.tile(np.arange(5000), 2)
    got = tile.scores(term, np.repeat([0, 1], 5000), np.full(10_000, 999_983), 2)
    assert got.tolist() == [[5000 * 26_000 * 999_983] * 2, [26_000 * 999_983] * 2]
    best = lexical.Best(1, 2)
    for ids in ([9, 8], [3, 7], [1, 2]):
        best.add(np.array([0]), np.array([[5, 5]]), np.array(ids), np.array([ids == [1, 2], False]))
    assert best.held[0][2].tolist() == [2, 3]


# --- manifest ----------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    proof = []
    for nodes in tree[:-1]:
        first = at - at % fanout
        proof.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return proof


def naive_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def naive_manifest(rows, fanout):
    """rows (doc_id, source, text) to sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for i, s, t in rows:
        groups.setdefault(s, []).append((i, naive_leaf((i, s, t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels([leaf for _, leaf in groups[s]], fanout)
    top = levels([trees[s][-1][0] for s in names], fanout)
    return sorted(
        (str(i), leaf, trees[s][-1][0], top[-1][0], siblings(trees[s], at, fanout) + siblings(top, k, fanout))
        for k, s in enumerate(names)
        for at, (i, leaf) in enumerate(groups[s])
    )


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_brute_force(spark, fanout):
    rnd = random.Random(fanout)
    rows = [(rnd.randrange(300), "hot" if rnd.random() < 0.6 else rnd.choice(["a", "é", "z", None, "", "B"]), rnd.choice(["x", "", None, "é" * 9])) for _ in range(130)]
    rows += [(None, "hot", "t"), (None, None, None), (5, "alone", "long " * 50_000), (7, "hot", "x"), (7, "hot", "x")]
    frame = odd(spark, [(i, t, s) for i, s, t in rows])
    values = {n: F.col(n) for n in ("doc_id", "source", "text")}
    got = merkle.manifest(frame, values, "source", "doc_id", {"size": F.length("text")}, fanout)
    back = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("wrong", merkle.fold(F.lit("0" * 64), F.col("proof"))).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in back) == naive_manifest(rows, fanout)
    assert all(r.folded == r.root != r.wrong for r in back)


def test_manifest_of_little(spark):
    values = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    assert merkle.manifest(odd(spark, [(1, "a", "s")]).where("false"), values, "source", "doc_id").count() == 0
    one = merkle.manifest(odd(spark, [(1, "a", None)]), values, "source", "doc_id").collect()
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in one] == [(h("1:1", "1:a"),) * 3 + ([],)]


def test_a_changed_text_is_found(spark):
    frame = odd(spark, [(i, f"Text {i}", f"s{i % 3}") for i in range(40)])
    values = {n: F.col(n) for n in ("doc_id", "text")}
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf([F.col("doc_id"), F.lower("text")]))
    got = merkle.manifest(frame, values, "source", "doc_id", {"changed": changed})
    folded = got.withColumn("folded", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))).collect()
    wrong = {r.doc_id for r in folded if r.folded != r.root}
    assert wrong == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0} and wrong


# --- parity join -----------------------------------------------------------------------


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def naive_join(rows, percent=85):
    sets = [gram_set(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    where = roots(len(rows), links)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(where[k], []).append(i)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return sorted(((i, len(sets[k]), least[where[k]]) for k, (i, _) in enumerate(rows)), key=str)


def changed_copies(rnd, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.choice([0, 1, 1, 2])] = [f"n{rnd.randrange(10**6)}"]
        out.append(" ".join(words))
    return out


def join_rows():
    rnd = random.Random(11)
    texts = [None, "", " \n", "one", "ONE", "one two three", "one  two\tthree", "a b c d", "é é é é"]
    passage = [f"p{i}" for i in range(40)]
    for size in (4, 6, 9, 15, 40, 90, 200):
        base = [f"b{size}w{i}" for i in range(size)]
        texts += [" ".join(base), *changed_copies(rnd, base, 25)]
        texts += [" ".join(passage + [f"q{rnd.randrange(10**6)}" for _ in range(size)]) for _ in range(3)]
    texts += ["long " + " ".join(f"x{i}" for i in range(30_000)), "long " + " ".join(f"x{i}" for i in range(28_000))]
    return [*enumerate(texts), (None, "one"), (None, "only here"), (500, "one two three"), (500, "one two three")]


@pytest.mark.parametrize("limit", [parity_join.BUCKET_LIMIT, 6])
def test_join_equals_brute_force(spark, limit):
    rows = join_rows()
    got = parity_join.jaccard_components(odd(spark, [(i, t, "s") for i, t in rows]), bucket_limit=limit).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == naive_join(rows)


def test_join_at_other_settings(spark):
    rows = join_rows()
    got = parity_join.jaccard_components(odd(spark, [(i, t, "s") for i, t in rows]), percent=60).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == naive_join(rows, 60)
    assert parity_join.jaccard_components(odd(spark, rows[:0])).count() == 0


def test_linked_sets_share_a_key_and_sketches_bound_the_difference():
    rnd = np.random.default_rng(2)
    for _ in range(3000):
        size = int(rnd.integers(1, 300))
        extra = int(rnd.integers(0, max(1, size // 5) + 1))
        everything = np.unique(rnd.integers(0, 2**64, size + extra, np.uint64))
        a, b = np.sort(rnd.permutation(everything)[:size]), everything[: int(rnd.integers(size, len(everything) + 1))]
        common = len(np.intersect1d(a, b))
        s, t = parity_join.sketch_of(a), parity_join.sketch_of(b)
        words = min(len(s), len(t))
        apart = int(np.bitwise_count(parity_join.folded(s, words) ^ parity_join.folded(t, words)).sum())
        assert apart <= len(a) + len(b) - 2 * common
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert np.intersect1d(parity_join.keys_of(a), parity_join.keys_of(b)).size


@pytest.mark.parametrize("most", [1 << 6, 1 << 25])
def test_sieves_keep_what_is_wanted(spark, monkeypatch, most):
    monkeypatch.setattr(parity_join, "SIEVE_BITS", (1 << 6, most))
    rows = spark.range(-3000, 3000).select(F.col("id").alias("sieve"), F.xxhash64("id").alias("key"))
    wanted = rows.where("sieve % 50 = 0")
    got = parity_join._sifted(rows, F.col("key"), wanted.select("key"))
    ids = [r.sieve for r in got.collect()]
    assert got.columns == rows.columns and len(set(ids)) == len(ids)
    assert {r.sieve for r in wanted.collect()} <= set(ids)
    assert most == 1 << 6 or len(ids) < 6000 // 50 + 6000 // 8
    assert most > 1 << 6 or len(ids) < 6000  # full sieves let more through
    assert parity_join._sifted(rows, F.col("key"), wanted.where("false").select("key")).count() == 0


def test_join_shuffles_wanted_texts_and_deletes_its_keys(spark, monkeypatch):
    kept, sifted = [], []

    def store(df):
        kept.append(original(df))
        return kept[-1]

    def sieve(rows, hashed, wanted):
        sifted.append((rows.columns, rows.count(), (got := through(rows, hashed, wanted)).count()))
        return got

    original, through = parity_join.store, parity_join._sifted
    monkeypatch.setattr(parity_join, "store", store)
    monkeypatch.setattr(parity_join, "_sifted", sieve, raising=False)
    texts = [" ".join(f"t{i}w{j}" for j in range(60)) for i in range(300)]
    rows = [*enumerate(texts), *enumerate((t + " end" for t in texts[:3]), 300), (303, texts[0] + " stop")]
    got = parity_join.jaccard_components(odd(spark, [(i, t, "s") for i, t in rows]))
    assert {(r.doc_id, r.component_id) for r in got.collect() if r.doc_id != r.component_id} == {(300, 0), (301, 1), (302, 2), (303, 0)}
    assert {"keys", "sketch"} <= {c for s in kept for c in s.columns}
    there = [s for s in kept if os.path.isdir(s._llm_path.removeprefix("file://"))]
    assert there and not any("keys" in s.columns for s in there)
    assert [n for columns, n, _ in sifted if "text" in columns] and all(out < n / 3 for _, n, out in sifted)


def test_tokens_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode() + b" Tail"
    whole = parity_join.tokens_of(text)
    monkeypatch.setattr(word_pieces, "PIECE", 37)
    assert (parity_join.tokens_of(text) == whole).all() and len(whole) == len(gram_set(text.decode()))
