"""Ranked lexical search: every document scored against every item by blocked dense multiplication.

An item's score for a document is a sum of whole numbers, weight times impact, over the item's terms.
Items are taken in tiles; a tile has a compact vocabulary of its items' terms only, so that weights
form a dense (items x terms) matrix and a tile of documents a dense (terms x documents) matrix of
impacts. Their product in double precision is exact: the terms multiplied at once are so few that no
partial sum can reach 2^53, and sums of several term tiles are added as 64-bit integers. Each task
keeps its k best documents of each item; a document that ties with the k-th is kept until its id decides.

The documents are read once for each block of items: a first pass counts each text's terms and stores
those in the block's vocabulary, with the sums that weights and impacts need (document frequencies,
number of documents, total length); the second pass reads those short rows. A block holds about
``block_terms`` item terms, so what is broadcast and collected is bounded however many items there are;
one item always stays whole.

Defined results: a null or empty text has no terms, is no document of N and is never ranked; rows
with one item_id (or with none) are one item with all their terms; repeated document rows are ranked
each; equal scores go by ascending doc_id, rows without one last; an item without terms, or that no
document matches, has no row; empty tables give an empty result; extra columns are ignored; texts are
read whole, a megabyte of words at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ebbgraph.llm.common import OUTPUT_ROWS, drop, store
from ebbgraph.llm.word_pieces import lowering_table, words_by_piece

TOP = 10
BLOCK_TERMS = 100_000
ITEM_TILE, TERM_TILE, DOCUMENT_TILE = 64, 2048, 512
EXACT = 1 << 53  # fixed value: doubles hold every whole number below it
#: Fixed values of the scoring rule.
LOG_SCALE, LENGTH_SHARE, LENGTH_BASE, IMPACT_SCALE, TF_SCALE, M_SCALE = 1000, 90, 100, 1_000_000_000, 1000, 8
IMPACT_LIMIT = IMPACT_SCALE // TF_SCALE
#: Bytes that are no part of a term (ASCII but for digits and letters).
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER = lowering_table(SEPARATORS)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, sorted) of every item that has any."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER_CASE, LOWER_CASE)
    each = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per row: doc_id, n (all terms), and the vocabulary's terms in it (ids) with their occurrences (tfs)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, OUTPUT_ROWS):
                part = batch.slice(start, OUTPUT_ROWS)
                lengths, ends, ids, tfs = [], [0], [], []
                for utf8 in part.column(1):
                    n, seen = 0, Counter()
                    for words in words_by_piece(utf8.as_py(), LOWER):
                        n += len(words)
                        seen.update(map(number, words))
                    seen.pop(None, None)
                    ids.extend(seen)
                    tfs.extend(seen.values())
                    lengths.append(n)
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(id_type), pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                    ],
                    names=["doc_id", "n", "ids", "tfs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n bigint, ids array<int>, tfs array<bigint>")


def weight(documents: int, df: int) -> int:
    return math.floor(LOG_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


class Tile:
    """Some items, their compact vocabulary in exact segments, and the weights as a matrix for each."""

    def __init__(self, items: list[tuple[int, list[int]]], weights: np.ndarray, term_tile: int):
        self.items = np.array([i for i, _ in items])
        terms = np.unique(np.concatenate([np.asarray(t, np.int64) for _, t in items]))
        heaviest = max(1, int(weights[terms].max()))
        width = max(1, min(term_tile, (EXACT - 1) // (heaviest * IMPACT_LIMIT)))
        self.segments = []
        for start in range(0, len(terms), width):
            own = terms[start : start + width]
            matrix = np.zeros((len(items), len(own)))
            for row, (_, t) in enumerate(items):
                mine = np.searchsorted(own, np.intersect1d(t, own))
                matrix[row, mine] = weights[own[mine]]
            place = np.full(len(weights), -1, np.int32)
            place[own] = np.arange(len(own))
            self.segments.append((matrix, place))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """(items x documents) whole-number scores of a tile of documents, given as (term, doc, impact) entries."""
        total = np.zeros((len(self.items), docs), np.int64)
        for matrix, place in self.segments:
            row = place[term]
            held = row >= 0
            dense = np.zeros((matrix.shape[1], docs))
            dense[row[held], doc[held]] = impact[held]
            total += (matrix @ dense).astype(np.int64)
        return total


class Best:
    """The k best (score, doc_id) of each item; ties by doc_id, none last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.held: list[tuple] = [None] * items
        self.least = np.ones(items, np.int64)  # a score below this cannot enter

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        rows, cols = np.nonzero(scores >= self.least[items][:, None])
        for row in np.unique(rows):
            col = cols[rows == row]
            item = items[row]
            new = scores[row, col], missing[col], ids[col]
            if self.held[item] is not None:
                new = tuple(np.concatenate(x) for x in zip(self.held[item], new))
            first = np.lexsort((new[2], new[1], -new[0]))[: self.k]
            self.held[item] = tuple(x[first] for x in new)
            if len(first) == self.k:
                self.least[item] = self.held[item][0][-1]


def best_of_tasks(counted: DataFrame, item_ids: list, terms: list[list[int]], weights: np.ndarray, documents: int, length: int, k: int, item_type) -> DataFrame:
    """item_id, doc_id, score: each task's k best documents of every item."""
    shipped = counted.sparkSession.sparkContext.broadcast((item_ids, terms, weights))
    id_type = to_arrow_type(counted.schema["doc_id"].dataType)
    name_type = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, heavy = shipped.value
        numbered = list(enumerate(wanted))
        tiles = [Tile(numbered[i : i + ITEM_TILE], heavy, TERM_TILE) for i in range(0, len(numbered), ITEM_TILE)]
        best = Best(len(names), k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENT_TILE):
                part = batch.slice(start, DOCUMENT_TILE)
                ids, n = part.column(0), part.column(1).to_pylist()
                m = np.array([LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * x * documents // length for x in n], np.int64)
                entries = part.column(2)
                doc = np.repeat(np.arange(len(n)), np.diff(entries.offsets.to_numpy()))
                tf = part.column(3).flatten().to_numpy()
                impact = IMPACT_SCALE * tf // (TF_SCALE * tf + M_SCALE * m[doc])
                term = entries.flatten().to_numpy()
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                values = np.array(ids.fill_null(0).to_pylist())
                for tile in tiles:
                    best.add(tile.items, tile.scores(term, doc, impact, len(n)), values, missing)
        out = [(names[i], None if gone else i_.item(), int(s)) for i, held in enumerate(best.held) if held is not None for s, gone, i_ in zip(*held)]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], name_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())], names=["item_id", "doc_id", "score"]
        )

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"item_id {item_type.simpleString()}, doc_id {kind}, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item, of all ``docs``."""
    docs = docs.select("doc_id", "text")
    listed = store(item_terms(items.select("item_id", "text")))
    item_type = items.schema["item_id"].dataType
    total = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    found: DataFrame | None = None
    for block in range(blocks):
        mine = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        vocabulary: dict[bytes, int] = {}
        terms = [[vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r.terms] for r in mine]
        counted = store(count_terms(docs, vocabulary))
        size = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        documents, length = size[0], size[1] or 0
        weights = np.full(len(vocabulary), weight(documents, 0), np.int64)
        for term, df in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a block's vocabulary at most
            weights[term] = weight(documents, df)
        rows = store(best_of_tasks(counted, [r.item_id for r in mine], terms, weights, documents, max(1, length), k, item_type))
        found = rows if found is None else found.unionByName(rows)
        drop(counted)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
