"""Ranked lexical search for many queries at once, by common subexpressions.

A term adds the same to a document's score whichever item asks for it, so items share work. Terms that the same items ask
for form a class, the largest term set that these items share; classes are mined by one grouping of terms by their items.
Classes stand in a fixed order, frequent ones first, and an item is built from its classes by halves: the part of an item
inside each pair of neighbouring ranges is one node, and parts that are equal in several items are the same node. That is
the query-sharing graph: every node has two parents at most one level below, and every item ends in one node.

Tasks take documents in batches. The accumulators of a batch, one row a class, are added up once from the batch's term
counts; each node of the graph is the sum of two rows before it, whatever number of items it serves. A task keeps each
item's best documents and sends ten an item; nothing is grouped by term, so a frequent term is no hot key.

Items are taken in blocks of about BLOCK_TERMS (item, term) pairs, so that what a task is sent is bounded; one block holds
some 30,000 questions. Documents' term counts are stored once a block, in the shared folder.

Defined cases: null and blank texts have no terms: such a document is no candidate, such an item has no rows; items of a
null item_id are left out, rows of one item_id are one item with all their terms; a null doc_id stands behind others of
its score; repeated rows are ranked each; texts of any length are taken whole; empty tables give no rows; columns of any
other name are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, utf8_bytes

TOP = 10
BLOCK_TERMS = 1 << 20
DOCUMENTS_AT_ONCE = 512
#: Weights in thousandths, and the share of length in a document's m in hundredths.
THOUSAND, UNIT, BASE, LENGTH_SHARE, SATURATION = 1000, 1_000_000_000, 100, 90, 8
#: Bytes for bytes.translate: A-Z to a-z; what is no letter, digit or byte of a longer sign becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = np.iinfo("int64").max


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (binary), each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(t.translate(TERM_BYTES).split())) for t in utf8_bytes(batch.column(1))]
            index = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.record_batch({"item_id": batch.column(0).take(pa.array(index)), "term": pa.array([t for x in own for t in x], pa.binary())})

    rows = items.where("item_id is not null").select("item_id", "text")
    return rows.mapInArrow(cut, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (those asked for) of every document that has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8_bytes(batch.column(1)):
                words = text.translate(TERM_BYTES).split()
                asked = [(terms[w], c) for w, c in Counter(words).items() if w in terms]
                rows.append((len(words), [t for t, _ in asked], [c for _, c in asked]))
            n, ids, tfs = zip(*rows, strict=True) if rows else ((), (), ())
            out = pa.record_batch({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "terms": pa.array(ids, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})
            yield out.filter(pa.array(np.array(n) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def term_classes(pairs: DataFrame) -> DataFrame:
    """items (sorted numbers), terms: the terms that just these items ask for. pairs: item, term."""
    return pairs.groupBy("term").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.array_sort(F.collect_list("term")).alias("terms"))


class SharingGraph:
    """Nodes 0.. are classes; then each of ``levels`` adds nodes, each the sum of two earlier ones. ``roots``: node of each item."""

    def __init__(self, classes: list[list[int]], items: int):
        """classes: the items of each class, those of many items first."""
        own: list[dict[int, int]] = [{} for _ in range(items)]  # place in the order, node
        for c, members in enumerate(classes):
            for item in members:
                own[item][c] = c
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = len(classes)
        while any(len(x) > 1 for x in own):
            made: dict[tuple[int, int], int] = {}
            for k, parts in enumerate(own):
                halves: dict[int, int] = {}
                for place in sorted(parts):
                    node, up = parts[place], place >> 1
                    halves[up] = node if up not in halves else made.setdefault((halves[up], node), nodes + len(made))
                own[k] = halves
            if made:
                pairs = np.array(list(made))
                self.levels.append((pairs[:, 0], pairs[:, 1]))
                nodes += len(made)
        self.nodes = nodes
        self.roots = np.array([next(iter(x.values())) for x in own], "int64")

    def evaluate(self, base: np.ndarray) -> np.ndarray:
        """Scores of all items, one row each, from the classes' accumulators (a row a class, a column a document)."""
        rows = np.empty((self.nodes, base.shape[1]), base.dtype)
        rows[: len(base)], at = base, len(base)
        for left, right in self.levels:
            np.add(rows[left], rows[right], out=rows[at : at + len(left)])
            at += len(left)
        return rows[self.roots]


class Best:
    """The best documents of each item so far; ties by document number, a missing one last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, "int64")
        self.item, self.doc, self.score = (np.zeros(0, "int64") for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, column = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        self.item, self.doc, self.score = (np.concatenate(x) for x in ((self.item, item), (self.doc, docs[column]), (self.score, scores[item, column])))
        order = np.lexsort((self.doc, -self.score, self.item))
        ranked = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        self.item, self.doc, self.score = (x[order[place < self.top]] for x in (self.item, self.doc, self.score))
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.top)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def best_of_block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """item_id, doc_id, score: at most ``top`` rows of each item and task, with all of an item's best among them."""
    numbered = sorted(r["item_id"] for r in pairs.select("item_id").distinct().collect())
    number = {x: k for k, x in enumerate(numbered)}
    own = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(list(number.items()), f"item_id {pairs.schema['item_id'].dataType.simpleString()}, item int")), "item_id")
    found = sorted(((r["items"], [bytes(t) for t in r["terms"]]) for r in term_classes(own).collect()), key=lambda c: (-len(c[0]), c[0]))
    words = [t for _, terms in found for t in terms]
    class_of = np.repeat(np.arange(len(found)), [len(terms) for _, terms in found])
    counted = stored(term_counts(docs, {t: k for k, t in enumerate(words)}), "term-counts")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holding = {r["t"]: r["df"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([math.floor(THOUSAND * math.log((2 * total["docs"] + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(words))], "int64")
    graph = SharingGraph([items for items, _ in found], len(numbered))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(numbered), top)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                rows = batch.slice(at, DOCUMENTS_AT_ONCE)
                n = rows.column(1).to_numpy()
                m = BASE - LENGTH_SHARE + LENGTH_SHARE * n * total["docs"] // total["length"]
                terms, tf = rows.column(2).flatten().to_numpy(), rows.column(3).flatten().to_numpy()
                column = np.repeat(np.arange(len(n)), rows.column(2).value_lengths().to_numpy())
                part = weights[terms] * (UNIT * tf // (THOUSAND * tf + SATURATION * m[column]))
                base = np.zeros((len(found), len(n)), "int64")
                np.add.at(base, (class_of[terms], column), part)
                best.add(graph.evaluate(base), rows.column(0).fill_null(NO_ID).to_numpy())
        if len(best.item):
            doc = pa.array(best.doc, mask=best.doc == NO_ID)
            yield pa.record_batch({"item": pa.array(best.item, pa.int32()), "doc_id": doc, "score": pa.array(best.score)})

    rows = counted.where(F.size("terms") > 0).mapInArrow(score, "item int, doc_id long, score long")
    names = pairs.sparkSession.createDataFrame(list(enumerate(numbered)), f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}")
    return rows.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents, highest score first, equal scores by doc_id."""
    pairs = stored(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    asked = [b for b in range(blocks) if blocks > 1 or not pairs.isEmpty()]
    none = docs.sparkSession.createDataFrame([], f"item_id {pairs.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
    found = reduce(DataFrame.unionByName, [best_of_block(docs, pairs.where(block == b), top) for b in asked], none)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
