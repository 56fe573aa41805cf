"""Benchmark decontamination by winnowing.

Of every RUN consecutive hashes of GRAM words the smallest is kept (the rightmost of equals). Two texts that share a
span of at least WINDOW = RUN + GRAM - 1 words have at least one whole run in common, so they keep the same hash at the
same place in it: joining kept hashes of documents and items finds every such pair. A pair's hits are then extended to
all that the two share: rolling hashes of WINDOW words of the document are looked up among the item's, and what is found
is compared word by word. Time is in proportion to both lengths, however often a text repeats itself.

Items with fewer than WINDOW words are one window each; for the few lengths that occur, documents keep all hashes of
that many words instead. Hashes only propose: the words decide.

While the items' distinct hashes are few (BROADCAST_HASHES), tasks drop other document hashes before the join, and the
items' side of the join is broadcast, so that a passage shared by many documents is no hot key; beyond that all go
through the shuffle join. A document is only compared with the items that its hashes name, items of equal text once.

Defined cases: null or wordless texts have no words and no windows; rows of equal doc_id, null included, are checked each
by its own text; repeated items, or items of equal text, all count; a null item_id is ignored; no documents give no rows,
no items leave all documents clean; texts are taken whole at any length; columns of any other name are ignored, and kept
by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, utf8_bytes

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
BROADCAST_HASHES = 2_000_000
BROADCAST_DOCUMENTS = 1_000_000
WORDS_HELD = 400_000
#: A-Z to a-z; ASCII that is no letter or digit to a space; the rest is part of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Odd multipliers of the rolling and mixing steps.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    total = np.zeros(n, "uint64")
    for k in range(size):
        total = total * ROLL + words[k : k + n]
    total ^= total >> np.uint64(32)
    return total * MIX


def winnow(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Positions kept: the smallest hash of each run, the rightmost of equals."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, "int64")
    at = np.arange(n) + run - 1
    least = hashes[run - 1 :].copy()
    for k in range(run - 2, -1, -1):
        other = hashes[k : k + n]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    return np.unique(at)


def kept_hashes(words: np.ndarray, short: list[int]) -> np.ndarray:
    """The distinct hashes by which a document can meet an item."""
    grams = gram_hashes(words, GRAM)
    found = [grams[winnow(grams)], *[gram_hashes(words, n) * ROLL + np.uint64(n) for n in short]]
    return np.unique(np.concatenate(found))


def item_hashes(items: DataFrame) -> DataFrame:
    """item_id (string), text, n_words, hashes; items without words are left out."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, counts, hashes = WordHashes(), [], []
        for text in utf8_bytes(batch.column(1)):
            own = words_of(text)
            coded = np.array([table[w] for w in own], dtype="uint64")
            counts.append(len(own))
            hashes.append(kept_hashes(coded, []) if len(own) >= WINDOW else gram_hashes(coded, len(own)) * ROLL + np.uint64(len(own)) if own else coded)
        return pa.record_batch({"item_id": batch.column(0), "text": batch.column(1), "n_words": pa.array(counts, pa.int64()), "hashes": pa.array([x.view("int64") for x in hashes], pa.list_(pa.int64()))})

    slim = items.where("item_id is not null").selectExpr("cast(item_id as string) item_id", "text")
    return stored(map_batches(slim, encode, "item_id string, text string, n_words long, hashes array<long>").where("n_words > 0"), "bench")


def document_hashes(docs: DataFrame, short: list[int], known: np.ndarray | None) -> DataFrame:
    """doc_id, key, n_words, hashes (those in ``known``, if given)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            counts, hashes = [], []
            for text in utf8_bytes(batch.column(2)):
                own = words_of(text)
                counts.append(len(own))
                found = kept_hashes(np.fromiter(map(table.__getitem__, own), "uint64", len(own)), short)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1) if len(known) else 0
                    found = found[known[at] == found] if len(known) else found[:0]
                hashes.append(found.view("int64"))
            yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(1), "n_words": pa.array(counts, pa.int64()), "hashes": pa.array(hashes, pa.list_(pa.int64()))})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text")
    return stored(slim.mapInArrow(encode, "doc_id long, key string, n_words long, hashes array<long>"), "winnowed")


def _key() -> F.Column:
    """Rows of one key have the same doc_id and text."""
    return F.concat_ws(":", "doc_id", F.xxhash64("text"))


class Document:
    """A document's words, and the hashes of its windows of each size that was asked for."""

    def __init__(self, text: bytes, table: WordHashes):
        self.words, self.grams = words_of(text), {}
        self.hashes = np.fromiter(map(table.__getitem__, self.words), "uint64", len(self.words))

    def windows(self, size: int) -> np.ndarray:
        if size not in self.grams:
            self.grams[size] = gram_hashes(self.hashes, size)
        return self.grams[size]


def shared_windows(document: Document, item: list[bytes], table: WordHashes) -> tuple[np.ndarray, int]:
    """Where the document has a window of the item, and the window's size."""
    size = min(WINDOW, len(item))
    theirs, at = np.unique(gram_hashes(np.array([table[w] for w in item], dtype="uint64"), size), return_index=True)
    own = document.windows(size)
    found = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
    places = np.flatnonzero(theirs[found] == own)
    words = document.words
    same = [words[p : p + size] == item[q : q + size] for p, q in zip(places.tolist(), at[found[places]].tolist(), strict=True)]
    if all(same):
        return places, size
    known = {tuple(item[q : q + size]) for q in range(len(item) - size + 1)}  # hashes collided
    return np.array([p for p in places.tolist() if tuple(words[p : p + size]) in known], dtype="int64"), size


def compare(pairs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items of each row of ``pairs`` (doc_id, text, items: item_ids and their text)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            rows = []
            for text, items in zip(utf8_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = Document(text, table)
                edges, names = np.zeros(len(own.words) + 1, "int64"), set()
                for item in items:
                    places, size = shared_windows(own, words_of((item["text"] or "").encode()), table)
                    if len(places):
                        edges[places] += 1
                        edges[places + size] -= 1
                        names.update(item["item_ids"])
                joined = ",".join(sorted(names))
                rows.append((len(own.words), int((np.cumsum(edges) > 0).sum()), len(names), hashlib.sha256(joined.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(columns[0], pa.int64()), "n_hit": pa.array(columns[1], pa.int64()), "n_items": pa.array(columns[2], pa.int64()), "items_sha256": pa.array(columns[3], pa.string())})

    return pairs.select("doc_id", "text", "items").mapInArrow(extend, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")


def candidates(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's word count, and for each key that meets an item the items with their texts."""
    bench = item_hashes(items)
    short = sorted(r["n_words"] for r in bench.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())  # at most 9
    texts = stored(bench.groupBy("text").agg(F.collect_set("item_id").alias("item_ids"), F.first("hashes").alias("hashes")).select(F.monotonically_increasing_id().alias("item"), "*"), "bench-texts")
    meeting = texts.select(F.explode("hashes").alias("hash"), "item")
    few = meeting.count() <= BROADCAST_HASHES
    known = np.sort(meeting.select("hash").distinct().toArrow()["hash"].to_numpy().view("uint64")) if few else None
    marked = document_hashes(docs, short, known)
    named = marked.select("key", F.explode("hashes").alias("hash")).join(F.broadcast(meeting) if few else meeting, "hash").select("key", "item").distinct()
    met = named.join(texts.select("item", "text", "item_ids"), "item").groupBy("key").agg(F.collect_list(F.struct("item_ids", "text")).alias("items"))
    return marked.select("doc_id", "key", "n_words"), stored(met, "bench-met")


def _only(docs: DataFrame, met: DataFrame, how: str) -> DataFrame:
    """Rows whose key met an item, or with ``left_anti`` the others. Keys alone are broadcast while they are few."""
    keys = met.select("key")
    return docs.join(F.broadcast(keys) if met.count() <= BROADCAST_DOCUMENTS else keys, "key", how)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    counted, met = candidates(docs, items)
    suspects = _only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key")), met, "left_semi").join(met, "key")
    nothing = hashlib.sha256(b"").hexdigest()
    clear = _only(counted, met, "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(nothing).alias("items_sha256"))
    return clear.unionByName(compare(suspects)).withColumn("contaminated", F.col("n_hit") > 0)


def decontamination_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item."""
    _, met = candidates(docs, items)
    keyed = docs.select(_key().alias("key"), F.struct(*docs.columns).alias("doc"))
    clear = _only(keyed, met, "left_anti").select("doc.*")
    suspects = _only(keyed, met, "left_semi").join(met, "key")
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("doc"))
            texts = utf8_bytes(rows.field("text"))
            keep = []
            for text, items in zip(texts, batch.column(batch.schema.get_field_index("items")).to_pylist(), strict=True):
                own = Document(text, table)
                keep.append(not any(len(shared_windows(own, words_of((x["text"] or "").encode()), table)[0]) for x in items))
            flat = pa.RecordBatch.from_struct_array(rows)
            yield flat.filter(pa.array(keep, pa.bool_()))

    return clear.unionByName(suspects.select("doc", "items").mapInArrow(clean, schema))
