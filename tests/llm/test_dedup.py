import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ebbgraph.llm import exact_dedup, lines, parity_join, simhash
from ebbgraph.llm.bktree import BKForest
from ebbgraph.llm.components import connected_components

DOCS = "doc_id long, text string, kept string, text_key int, runs string, `mark_doc` int"
WHITE = str.maketrans("", "", " \t\n\r\x0b\x0c")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS).repartition(3)


ROWS = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (7, "c"), (None, "c"), (1, None), (2, ""), (4, " \n"), (6, "long " * 5000), (8, "long " * 4999 + "long"),
    (10, "only"), (11, "twice"), (11, "twice"), (12, "same id"), (12, "other text"), (13, "é b"), (14, "é b"),
]


def order(row):
    return row[0] is not None, row[0] or 0


def test_exact_groups_equal_brute_force(spark):
    groups = {}
    for row in ROWS:
        groups.setdefault((row[1] or "").translate(WHITE), []).append(row)
    want = set()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), *order(r)))
        for i, t in set(members):
            want.add((i, t or "", best[0], len(members), (i, t) == best))
    got = exact_dedup.exact_groups(docs(spark, ROWS), {"carried": F.coalesce("text", F.lit(""))}).collect()
    assert {(r.doc_id, r.carried, r.keep_id, r.group_size, r.kept) for r in got} == want
    assert len(got) == len(want)


def test_exact_dedup_keeps_one_of_each(spark):
    frame = docs(spark, ROWS)
    out = exact_dedup.exact_dedup(frame)
    assert out.columns == frame.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len({(t or "").translate(WHITE) for _, t in ROWS})
    assert {(9, "a  b"), (None, "c"), (4, " \n"), (6, "long " * 5000), (11, "twice")} <= set(got)


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, simhash.near_dedup, simhash.similar_dedup, lines.dedup_lines])
def test_empty_tables(spark, operator):
    assert operator(docs(spark, ROWS).where("false")).count() == 0


def test_nothing_to_drop(spark):
    assert exact_dedup.exact_dedup(docs(spark, [(1, "a"), (2, "b")])).count() == 2


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_fingerprints_and_hash_of_the_engine(spark):
    texts = [None, "", " \t", "one", "One two", "one two three", "a b c d e f", "Ä ö Ü x", "w " * 100_000, "x y z"]
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs(spark, enumerate(texts))).collect()}
    assert {i: x & (2**64 - 1) for i, x in got.items()} == {i: naive_fingerprint(t) for i, t in enumerate(texts)}
    # a single shingle's fingerprint is its hash, and that is the engine's own xxhash64
    assert got[4] == spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "hi", "hi"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            copy[rnd.randrange(120)] = rnd.choice(words)
            texts.append(" ".join(copy))
    prints = [naive_fingerprint(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(len(texts), linked)
    got = simhash.near_duplicates(docs(spark, enumerate(texts))).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    kept = simhash.near_dedup(docs(spark, [*enumerate(texts), (0, None), (3, "hi")]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert 4 < len(set(want)) < len(texts)


def test_near_dedup_without_ids(spark):
    got = simhash.near_dedup(docs(spark, [(None, "a b c"), (None, "a b c"), (None, "x y z u"), (1, "p q r")]))
    assert sorted(r.text for r in got.collect()) == ["a b c", "p q r", "x y z u"]


def similar_pairs(texts, n=5, percent=80):
    """Index pairs of texts whose word shingles are alike enough, counted on all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def near_copies(rnd, groups=12, copies=8, length=120, edits=3):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(length)]
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rnd.randrange(1, edits + 1)):
                copy[rnd.randrange(length)] = rnd.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("limit", [8, 1024])
def test_similar_groups_equal_brute_force(spark, limit):
    texts = [None, "", "hi", "HI", "one two three four", "one two three", "long word " * 30_000, "word long " * 30_000]
    texts += near_copies(random.Random(4))
    # a passage that many texts share, too short to link them
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"o{i}x{j}" for j in range(30)) for i in range(40)]
    want = roots(len(texts), similar_pairs(texts))
    assert 12 + 40 < len(set(want)) < len(texts)
    frame = docs(spark, [*enumerate(texts), (0, None), (3, "HI")])
    got = simhash.similar_groups(frame, tree_limit=limit).collect()
    assert len(got) == len(texts) + 2
    groups = {}
    for r in got:
        groups.setdefault(r.root, []).append(r.doc_id)
    assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(want))
    kept = simhash.similar_dedup(frame, tree_limit=limit)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_similar_dedup_without_ids(spark):
    got = simhash.similar_dedup(docs(spark, [(None, "a b c"), (None, "a b c"), (None, "x y z u"), (1, "p q r"), (None, None), (2, " ")]))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a b c"), (0, "x y z u"), (1, "p q r"), (2, " ")]


def test_similar_groups_find_near_copies_of_the_corpus(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    exact = parity_join.jaccard_components(corpus, words=5, percent=80).where("n_shingles > 0").select("doc_id", "component_id")
    found = simhash.similar_groups(corpus).select("doc_id", "root")
    both = exact.join(found, "doc_id")
    counts = both.agg(
        F.count_distinct("component_id").alias("exact"), F.count_distinct("root").alias("found"),
        F.count_distinct("component_id", "root").alias("parts"), F.count_distinct("doc_id").alias("docs"),
    ).first()
    assert counts.parts == counts.found  # nothing that the exact join keeps apart is joined
    assert counts.docs - counts.found >= 0.98 * (counts.docs - counts.exact) > 0


def test_closest_forest_is_a_minimum_spanning_forest():
    rnd = random.Random(1)
    for _ in range(100):
        n = rnd.randrange(1, 30)
        pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.15]
        a, b = (np.array([p[k] for p in pairs], np.int32) for k in (0, 1))
        apart = np.array([rnd.randrange(6) for _ in pairs], np.int64)
        x, y = simhash.closest_forest(a, b, apart, n)
        chosen = set(zip(x.tolist(), y.tolist()))
        assert roots(n, chosen) == roots(n, pairs) and len(chosen) == len(x) == n - len(set(roots(n, pairs)))
        weight = dict(zip(pairs, apart.tolist()))
        least, tree = 0, []
        for p in sorted(pairs, key=weight.get):
            if len(set(roots(n, [*tree, p]))) < len(set(roots(n, tree))):
                tree.append(p)
                least += weight[p]
        assert sum(weight[p] for p in chosen) == least


@pytest.mark.parametrize("limit", [4, 4096])
def test_links_of_dense_shards_equal_brute_force(spark, limit):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for centre in [rnd.getrandbits(64) for _ in range(3)]:
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 2, 3, 5)))))
    prints = sorted(prints)
    want = roots(len(prints), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    links = [(signed.index(r.x), signed.index(r.y)) for r in simhash.fingerprint_links(frame, 3, limit).collect()]
    assert roots(len(prints), links) == want
    assert len(links) <= 4 * len(prints) * (1 if limit > 1000 else 60)


def test_trees_find_all_pairs():
    rnd = np.random.default_rng(1)
    values, tree = rnd.integers(0, 1 << 12, 500, dtype=np.uint64), np.sort(rnd.integers(0, 7, 500))
    keep = np.unique(np.stack([tree.astype(np.uint64), values]), axis=1)
    tree, values = keep[0].astype(np.int64), keep[1].copy()
    got = {(int(a), int(b)) for q, n in BKForest(values, tree).near(2) for a, b in zip(q, n)}
    want = {
        (a, b) for b, a in itertools.combinations(range(len(values)), 2)
        if tree[a] == tree[b] and (int(values[a]) ^ int(values[b])).bit_count() <= 2
    }
    assert got == want


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = roots(300, edges)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.node for r in got} == nodes
    by_root = {}
    for r in got:
        by_root.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(n for n in nodes if want[n] == w) for w in {want[n] for n in nodes})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_lines(rows, least):
    """Lines that lie in a window whose content starts at an earlier place."""
    seen, gone = {}, set()
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in rows:
        full = [(n, x.strip(), len(x.split())) for n, x in enumerate((text or "").split("\n")) if x.split()]
        for s in range(len(full)):
            total, e = 0, s
            while e < len(full) and total < least:
                total += full[e][2]
                e += 1
            if total < least:
                break
            key = tuple(x for _, x, _ in full[s:e])
            if seen.setdefault(key, (i, full[s][0])) != (i, full[s][0]):
                gone |= {(i, n) for n in range(full[s][0], full[e - 1][0] + 1)}
    return {i: "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone) if text is not None else None for i, text in rows}


@pytest.mark.parametrize("least", [4, 50])
def test_line_dedup_equals_brute_force(spark, least):
    rnd = random.Random(least)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))) for _ in range(25)]
    rows = [(None, "a b\nc d e"), (0, None), (1, ""), (2, "\n\n"), (3, "a b\n\n\nc d e\nx y")]
    for i in range(4, 60):
        texts = [rnd.choice(pool) + rnd.choice(("", " ", "\r")) for _ in range(rnd.randint(1, 40))]
        rows.append((i, "\n".join(texts)))
    rows += [rows[-1], (99, "z " * 60 + "\n" + "z " * 60)]
    out = lines.dedup_lines(docs(spark, rows), least)
    got = out.collect()
    want = naive_lines(rows, least)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    for r in got:
        before = next(t for i, t in rows if i == r.doc_id)
        assert r.n_lines == len((before or "").split("\n"))
        kept = 0 if r.n_deleted == r.n_lines else len((r.text or "").split("\n"))
        assert r.n_lines - r.n_deleted == kept
    assert out.columns[:6] == docs(spark, rows).columns


def maximal_runs(rows, least):
    """Lines of every maximal run of equal lines, with enough words, that two places share: the later place's lines."""
    places = [
        ((i is not None, i or 0), n, x.strip(), len(x.split()), i)
        for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)) for n, x in enumerate((text or "").split("\n")) if x.split()
    ]
    same = lambda a, b: b < len(places) and places[a][2] == places[b][2]
    follows = lambda a: a > 0 and places[a - 1][0] == places[a][0]
    gone = set()
    for b in range(len(places)):
        for a in range(b):
            if not same(a, b) or (follows(a) and follows(b) and same(a - 1, b - 1)):
                continue
            k = 1
            while same(a + k, b + k) and follows(a + k) and follows(b + k):
                k += 1
            if sum(p[3] for p in places[b : b + k]) >= least:
                gone |= {(places[b][4], n) for n in range(places[b][1], places[b + k - 1][1] + 1)}
    return {i: "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone) if text is not None else None for i, text in rows}


@pytest.mark.parametrize("least", [4, 12, 50])
def test_whole_runs_equal_brute_force(spark, least):
    rnd = random.Random(least)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((0, 1, 2, 3, 4, least)))) for _ in range(25)]
    runs = [[rnd.choice(pool) for _ in range(rnd.randint(2, 12))] for _ in range(8)]
    rows = [(None, "a b\nc d e"), (0, None), (1, ""), (2, "\n\n")]
    for i in range(4, 50):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            run = rnd.choice(runs)
            parts += run[rnd.randint(0, 2) : rnd.randint(3, 12)] + [rnd.choice(pool) + rnd.choice(("", " ", "\r")) for _ in range(rnd.randint(0, 3))]
        rows.append((i, "\n".join(parts)))
    rows += [rows[-1], (99, "z " * 60 + "\n" + "z " * 60)]
    got = lines.dedup_lines(docs(spark, rows), least, whole_runs=True).collect()
    want = maximal_runs(rows, least)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert want != naive_lines(rows, least)


def test_short_tail_of_a_repeated_run_goes(spark):
    # the second place's tail continues the match; the third repeats a place that is not the first of its long line
    long, tail, other = "w " * 60, "only three words", "another tail"
    rows = [(1, f"{long}\nhere alone"), (2, f"{long}\n{tail}\n{other}"), (3, f"own line\n{long}\n\n{tail}\n{other}\nown end")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup_lines(docs(spark, rows), whole_runs=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"{tail}\n{other}", 1), 3: ("own line\nown end", 4)}


def test_line_dedup_replaces_columns_of_its_names(spark, tmp_path):
    text = "\n".join(["w " * 60] * 2)
    given = spark.createDataFrame([(1, text, 7, "x", "y")], "doc_id long, text string, N_lines int, n_deleted string, runs string")
    lines.dedup_lines(given).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["doc_id", "text", "runs", "n_lines", "n_deleted"]
    assert [tuple(r) for r in got.collect()] == [(1, "w " * 60, "y", 2, 1)]
