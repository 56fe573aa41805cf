"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability q = sigmoid(b + sum of the weights of its
distinct words), where a word's weight adds up the weights of the word and of its first characters; a sentence without
any weighed word gives no evidence and has q = 0. A document is toxic if any sentence is: P = 1 - prod(1 - q), the
noisy-or. Only documents carry labels; the gradient of the document likelihood decides which sentences are to blame,
and after training the sentence probabilities say where the offence is.

Words and beginnings are screened first: over all labelled training documents their document frequencies are counted
per class, and those that separate the classes (two-proportion z of LEAST_Z or more, in LEAST_DOCUMENTS or more) get
weights, however many they are. Training is full-batch Adam; each step is one job in which every task sums the gradient
over its documents, and one number a feature comes back; it ends early once the gradient is small. At most
LABELLED_DOCUMENTS labelled documents train, those of the smallest hashes of doc_id; this bounds model and steps.

Defined cases: a null or blank text has no sentences and scores 0; a document with several label rows counts as toxic
if any says so, null labels and labels of a null doc_id are ignored; without labels of both classes, or without a word
that separates them, every document scores 0 and none is dropped, however long; repeated rows train and are scored
each, rows of a null doc_id are scored and, by the crc32 of the empty text, held out; no rows give no rows; texts are
taken whole at any length; columns of any other name are ignored, and kept by the stage.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, map_batches, stored, utf8_bytes

LABELLED_DOCUMENTS = 500_000
LEAST_DOCUMENTS = 3
LEAST_Z = 4.0
BEGINNINGS = (4, 6)
STEPS = 60
RATE = 0.3
DECAY = 2e-5
START_BIAS = -6.0
SMALL_GRADIENT = 1e-7
#: Labels are broadcast up to this number of rows (two small numbers each); beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000
WORDS_HELD = 300_000
#: A-Z to a-z; line ends and . ! ? end a sentence; other ASCII that is no letter or digit separates words.
SENTENCE_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".!?\r\n" else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [words for line in text.translate(SENTENCE_BYTES).split(b"\n") if (words := line.split())]


def word_features(word: bytes) -> list[bytes]:
    """The word, and its first characters marked with a star, which no word holds."""
    if word.isascii():
        return [word, *[word[:n] + b"*" for n in BEGINNINGS if len(word) > n]]
    text = word.decode("utf-8", "surrogateescape")
    return [word, *[text[:n].encode("utf-8", "surrogateescape") + b"*" for n in BEGINNINGS if len(text) > n]]


@dataclass(frozen=True)
class SentenceModel:
    words: dict[bytes, int]  # feature numbers
    weights: np.ndarray  # one per feature, then the bias

    def word_weight(self, word: bytes) -> float:
        """0 if the word has no feature."""
        return float(sum(self.weights[self.words[f]] for f in word_features(word) if f in self.words))


class WordWeights(dict):
    """Weights of the words met so far, a bounded number of them."""

    def __init__(self, model: SentenceModel):
        super().__init__()
        self.model, self.bias = model, float(model.weights[-1])

    def __missing__(self, word: bytes) -> float:
        if len(self) > WORDS_HELD:
            self.clear()
        found = self[word] = self.model.word_weight(word)
        return found


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCUMENTS) -> DataFrame:
    """text and toxic of ``most`` labelled documents; one label per doc_id, toxic if any row says so."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    few = known.count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic")


def screen(train: DataFrame) -> list[bytes]:
    """The words whose document frequencies differ most between the classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(utf8_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = {f for w in {w for s in sentences(text) for w in s} for f in word_features(w)}
                own.add(b"")  # counts documents
                seen[toxic > 0].update(own)
            if len(seen[0]) + len(seen[1]) > WORDS_HELD:
                yield _counts(*seen)
                seen[0].clear(), seen[1].clear()
        yield _counts(*seen)

    counts = stored(train.mapInArrow(count, "word binary, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "tox-words")
    total = counts.where("word = X''").first()
    if total is None or not total["neg"] or not total["pos"]:
        return []
    neg, pos = F.lit(float(total["neg"])), F.lit(float(total["pos"]))
    rate = (F.col("neg") + F.col("pos") + 0.5) / (neg + pos + 1.0)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(rate * (1.0 - rate) * (1.0 / pos + 1.0 / neg))
    usable = counts.where((F.col("word") != F.lit(b"")) & (F.col("neg") + F.col("pos") >= LEAST_DOCUMENTS))
    return usable.where(F.abs(z) >= LEAST_Z).select("word").orderBy("word").toArrow()["word"].to_pylist()


def _counts(neg: Counter, pos: Counter) -> pa.RecordBatch:
    words = list(neg.keys() | pos.keys())
    return pa.record_batch({"word": pa.array(words, pa.binary()), "neg": pa.array([neg[w] for w in words], pa.int64()), "pos": pa.array([pos[w] for w in words], pa.int64())})


def instances(train: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """Per document: toxic, and the feature and sentence numbers of what its sentences hold."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        features, owners = [], []
        for text in utf8_bytes(batch.column(0)):
            got, own = [], []
            for s in sentences(text):
                found = [words[f] for w in set(s) for f in word_features(w) if f in words]
                if found:
                    own += [len(own) and own[-1] + 1] * len(found)
                    got += found
            features.append(got), owners.append(own)
        lists = pa.list_(pa.int32())
        return pa.record_batch({"toxic": batch.column(1).cast(pa.int32()), "features": pa.array(features, lists), "owners": pa.array(owners, lists)})

    return stored(map_batches(train, encode, "toxic int, features array<int>, owners array<int>"), "tox-bags")


def log_sigmoid_gap(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0.0, z)


def bag_gradient(weights: np.ndarray, toxic: np.ndarray, bag: np.ndarray, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood. owner: sentence of each feature; bag: document of each sentence."""
    bias = weights[-1]
    z = bias + np.bincount(owner, weights[features], len(bag))
    q = 1 / (1 + np.exp(-z))
    clean = np.bincount(bag, log_sigmoid_gap(z), len(toxic))
    share = np.where(toxic > 0, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0)
    by_sentence = q * share[bag]
    out = np.bincount(features, by_sentence[owner], len(weights)).astype(float)
    out[-1] = by_sentence.sum()
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.diff(column.offsets.to_numpy())


def fit(bags: DataFrame, words: list[bytes], steps: int = STEPS) -> SentenceModel:
    documents = bags.count()
    weights = np.zeros(len(words) + 1)
    weights[-1] = START_BIAS
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1 if words else 1):
        now = weights.copy()

        def part(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                features, n = _flat(batch.column(1))
                owner, _ = _flat(batch.column(2))
                ends = np.cumsum(n)
                sentence_counts = np.array([0 if not c else owner[e - 1] + 1 for c, e in zip(n, ends, strict=True)], dtype="int64")
                starts = np.cumsum(sentence_counts) - sentence_counts
                bag = np.repeat(np.arange(batch.num_rows), sentence_counts)
                total += bag_gradient(now, batch.column(0).to_numpy(), bag, features, owner + np.repeat(starts, n))
            used = np.flatnonzero(total)
            yield pa.record_batch({"k": pa.array(used, pa.int64()), "g": pa.array(total[used])})

        gradient = np.zeros_like(weights)
        for row in bags.mapInArrow(part, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect():
            gradient[row["k"]] = row["g"]
        gradient = gradient / max(documents, 1) - DECAY * np.append(weights[:-1], 0.0)
        if np.abs(gradient).max() < SMALL_GRADIENT:
            break
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights = weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return SentenceModel({w: k for k, w in enumerate(words)}, weights)


def train_model(docs: DataFrame, labels: DataFrame, *, most: int = LABELLED_DOCUMENTS, steps: int = STEPS) -> SentenceModel:
    train = labelled(docs, labels, most)
    words = screen(train)
    return fit(instances(train, {w: k for k, w in enumerate(words)}), words, steps)


def score_bytes(weights: WordWeights, text: bytes) -> tuple[float, int, list[int], list[float]]:
    """Noisy-or score, number of sentences, and the numbers and probabilities of sentences of 0.5 or more."""
    weigh, own = weights.__getitem__, sentences(text)
    evidence = [(k, found) for k, words in enumerate(own) if (found := [x for x in map(weigh, set(words)) if x])]
    if not evidence:
        return 0.0, len(own), [], []
    z = weights.bias + np.array([math.fsum(found) for _, found in evidence])
    hot = np.flatnonzero(z >= 0)
    return float(-np.expm1(log_sigmoid_gap(z).sum())), len(own), [evidence[k][0] for k in hot], (1 / (1 + np.exp(-z[hot]))).tolist()


def score_documents(docs: DataFrame, model: SentenceModel, keep: list[str]) -> DataFrame:
    """``keep`` columns (without names below), then score, n_sentences, offending (sentence, probability)."""
    kept = docs.select(*keep, "text")
    schema = kept.schema
    names = [f.name for f in schema.fields[:-1]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = WordWeights(model)
        rows = [score_bytes(weights, x) for x in utf8_bytes(batch.column(len(names)))]
        value, n, where, how = zip(*rows, strict=True)
        offending = [[{"sentence": i, "probability": p} for i, p in zip(a, b, strict=True)] for a, b in zip(where, how, strict=True)]
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("probability", pa.float64())]))
        return pa.record_batch({c: batch.column(k) for k, c in enumerate(names)} | {"score": pa.array(value), "n_sentences": pa.array(n, pa.int32()), "offending": pa.array(offending, kind)})

    return map_batches(kept, score, f"{kinds}, score double, n_sentences int, offending array<struct<sentence:int,probability:double>>")


def held_out() -> F.Column:
    return id_hash() % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out and score every document."""
    model = train_model(docs.where(~held_out()), labels)
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def offending_sentences(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """The located sentences with their words: doc_id, sentence, probability, words."""

    def locate(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, weights = [], WordWeights(model)
        for doc, text in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), strict=True):
            _, _, where, how = score_bytes(weights, text)
            if where:
                own = sentences(text)
                rows += [(doc, i, p, b" ".join(own[i]).decode("utf-8", "replace")) for i, p in zip(where, how, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())], names=["doc_id", "sentence", "probability", "words"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), locate, "doc_id long, sentence int, probability double, words string")


def toxicity_stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; rows and columns otherwise as they are."""
    model = train_model(docs.where(~held_out()), labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = WordWeights(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = [score_bytes(weights, x)[0] < 0.5 for x in utf8_bytes(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
