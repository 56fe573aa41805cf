"""A hidden Markov language model.

Counting: each training token's count c, their sum N and number V come from one pass over the training documents. The
ALPHABET most frequent words seen LEAST_COUNT times are symbols of their own, whose emissions every task holds; every
other word falls into one of BUCKETS symbols by its last bytes while the states are trained.

Training is Baum-Welch over all training documents: in each round every task runs the scaled forward-backward
recursion over its documents and sums expected counts of starts, transitions and emissions; they are added up by symbol
and the next model is made from them, smoothed toward the unigram distribution. The last round also adds up the expected
counts of every word outside the alphabet (a document's in 16-bit parts of its tokens), in a table with a row a word that stays distributed, so each training word
has emissions of its own and what is gathered grows with the input. Within a bucket and state the share of a word is

    (l E + ((1 - l) c + 0.5) q) / Z,  l = c / (c + SHRINK)

with its expected count E in the state and the state's part q of the bucket; Z adds them up, with 0.5 q for words never
seen. So the model is a proper distribution over texts.

Scoring: the scaled forward recursion in double precision gives the exact likelihood. Words outside the alphabet meet their
row of the table in a shuffle join, once a document however often it holds the word, and their emissions are made in the
task that scores the document.

A word of more than LONGEST_WORD bytes is counted, coded and joined by a digest of 128 bits, so no word takes more memory.

Defined cases: null or blank text is just the end token; rows of equal doc_id, null included, are kept apart by a row
number fixed in a stored table; without training documents c = 0 everywhere and the base score is 0.5 / 0.5 for each
token; no rows give no rows; texts of any length are read whole, in chunks of bounded tokens but for a single longer text;
other columns of whatever names are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, drop_stored, id_hash, stored, utf8_bytes

STATES = 8
#: Words whose emissions every task holds; further ones are joined.
ALPHABET = 1 << 16
LONGEST_WORD = 64
LEAST_COUNT = 3
BUCKETS = 256
ROUNDS = 5
STAY = 0.9
PRIOR, PRIOR_SHARE = 50.0, 0.01
TOKENS_A_CHUNK = 3 << 18
WORDS_HELD = 300_000
#: Training tokens of a word outside the alphabet that weigh as much as its bucket's states.
SHRINK = 2.0
#: Their tokens' parts in the states are kept in 16 bits.
PARTS = (1 << 16) - 1
#: Rows of expected counts that travel together.
ROWS_A_BLOCK = 512
#: The end token in the table of counts; words hold no white space.
END = b"\n"


def held_out() -> F.Column:
    return id_hash() % 5 == 1


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text; long ones as an end token's sign, which no word holds, and a digest."""
    return [w if len(w) <= LONGEST_WORD else END + hashlib.md5(w).digest() for w in text.translate(ASCII_LOWER).split()]


def count_tokens(train: DataFrame) -> DataFrame:
    """word, c: counts of all training tokens, the end token included. Summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in utf8_bytes(batch.column(0)):
                seen.update(tokens_of(text))
                if len(seen) > WORDS_HELD:
                    yield _counted(seen)
                    seen.clear()
            seen[END] += batch.num_rows
        yield _counted(seen)

    return stored(train.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(seen.keys(), pa.binary()), "c": pa.array(seen.values(), pa.int64())})


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


@dataclass(frozen=True)
class Alphabet:
    """Symbols: words by falling count, then the buckets, then the end token."""

    words: list[bytes]
    counts: np.ndarray  # c of each word
    bucket_sums: np.ndarray  # sum of c + 0.5 over a bucket's words, and 0.5 for words never seen
    end_count: int
    tokens: int  # N
    distinct: int  # V

    @property
    def size(self) -> int:
        return len(self.words) + BUCKETS + 1

    @property
    def log_base_total(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def unigram(self) -> np.ndarray:
        weight = np.concatenate([self.counts + 0.5, self.bucket_sums, [self.end_count + 0.5]])
        return weight / weight.sum()


def make_alphabet(counts: DataFrame, size: int = ALPHABET) -> Alphabet:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    words = counts.where(F.col("word") != F.lit(END))
    top = words.where(F.col("c") >= LEAST_COUNT).orderBy(F.desc("c"), "word").limit(size).toArrow()
    sums = np.full(BUCKETS, 0.5)
    for row in words.groupBy(bucket_number().alias("b")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("s")).collect():
        sums[row["b"]] += row["s"]
    kept = top["word"].to_pylist()
    own = top["c"].to_numpy().astype("int64")
    np.subtract.at(sums, [bucket(w) for w in kept], own + 0.5)
    return Alphabet(kept, own, np.maximum(sums, 0.5), total["ends"], total["n"], total["v"])


def encode_texts(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """row, doc_id, held_out, symbols (with the end), rare and groups (distinct words outside the alphabet, their buckets), stored.

    A symbol of ``alphabet.size`` or more is a place in the document's own ``rare``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: k for k, w in enumerate(alphabet.words)}
        end = alphabet.size - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                symbols, rare, groups = [], [], []
                for text in utf8_bytes(rows.column(3)):
                    places: dict[bytes, int] = {}
                    own = []
                    for w in tokens_of(text):
                        k = index.get(w)
                        own.append(end + 1 + places.setdefault(w, len(places)) if k is None else k)
                    own.append(end)
                    symbols.append(np.array(own, dtype="int32")), rare.append(list(places)), groups.append([bucket(w) for w in places])
                yield pa.record_batch({"row": rows.column(0), "doc_id": rows.column(1), "held_out": rows.column(2), "symbols": pa.array(symbols, pa.list_(pa.int32())), "rare": pa.array(rare, pa.list_(pa.binary())), "groups": pa.array(groups, pa.list_(pa.int32()))})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return stored(numbered.mapInArrow(encode, "row long, doc_id long, held_out boolean, symbols array<int>, rare array<binary>, groups array<int>"), "lm-symbols")


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def first_model(alphabet: Alphabet, states: int = STATES, seed: int = 5) -> Model:
    """Unigram emissions, each disturbed by a seeded factor so that states can part; states tend to stay."""
    base = alphabet.unigram()
    emit = base[:, None] * np.exp(np.random.default_rng(seed).normal(0.0, 0.7, (len(base), states)))
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


@dataclass(frozen=True)
class Lattice:
    """Documents side by side: tokens ordered by position and, at each position, longest document first."""

    order: np.ndarray  # documents, longest first
    edges: np.ndarray  # where each position's tokens begin
    symbols: np.ndarray
    before: np.ndarray  # for each token after position 0, its predecessor

    @staticmethod
    def of(symbols: np.ndarray, lengths: np.ndarray) -> Lattice:
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
        edges = np.concatenate([[0], np.cumsum(alive)])
        position = np.repeat(np.arange(len(alive)), alive)
        rank = np.arange(edges[-1]) - edges[position]
        later = slice(alive[0], None)
        return Lattice(order, edges, symbols[starts[order][rank] + position], edges[position[later] - 1] + rank[later])


def log10_likelihood(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document, exactly: the scaled forward recursion; the logarithms of the scales add up."""
    lattice = Lattice.of(symbols, lengths)
    edges, sums = lattice.edges, np.zeros(len(lengths))
    now = np.broadcast_to(model.start, (edges[1], len(model.start)))
    for t in range(len(edges) - 1):
        own = lattice.symbols[edges[t] : edges[t + 1]]
        now = now[: len(own)] * model.emit[own]
        total = now.sum(axis=1)
        sums[: len(own)] += np.log10(total)
        now = (now / total[:, None]) @ model.move
    out = np.empty_like(sums)
    out[lattice.order] = sums
    return out


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, transitions and emissions, and the natural log-likelihood."""
    lattice = Lattice.of(symbols, lengths)
    edges, move = lattice.edges, model.move.astype(np.float32)
    rows = model.emit.astype(np.float32)[lattice.symbols]
    alpha, scale = np.empty_like(rows), np.empty(len(rows), np.float32)
    now = np.broadcast_to(model.start.astype(np.float32), (edges[1], len(model.start)))
    for t in range(len(edges) - 1):
        low, high = edges[t], edges[t + 1]
        now = now[: high - low] * rows[low:high]
        total = now.sum(axis=1)
        now /= total[:, None]
        alpha[low:high], scale[low:high] = now, total
        now = now @ move
    beta, weighed = np.ones_like(alpha), rows  # emissions become emission * beta / scale of each token
    for t in range(len(edges) - 2, -1, -1):
        low, high = edges[t], edges[t + 1]
        if t < len(edges) - 2:
            later = weighed[high : edges[t + 2]]
            beta[low : low + len(later)] = later @ move.T
        weighed[low:high] *= beta[low:high] / scale[low:high, None]
    first = edges[1]
    moves = model.move * (alpha[lattice.before].T @ weighed[first:]).astype(float)
    gamma = np.multiply(alpha, beta, out=beta)
    emissions = np.stack([np.bincount(lattice.symbols, g, len(model.emit)) for g in gamma.T], axis=1)
    return gamma[:first].sum(axis=0, dtype=float), moves, emissions, float(np.log(scale.astype(float)).sum())


def next_model(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray) -> Model:
    states = len(starts)
    start = (starts + 1.0) / (starts.sum() + states)
    move = (moves + 1.0) / (moves.sum(axis=1, keepdims=True) + states)
    mass = emissions.sum(axis=0)
    prior = PRIOR + PRIOR_SHARE * mass
    emit = (emissions + prior * unigram[:, None]) / (mass + prior)
    return Model(start, move, emit)


@dataclass(frozen=True)
class Chunk:
    """Documents of like lengths. A symbol of ``size`` or more is a place in ``rare``, which points into the batch's rare words."""

    documents: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    rare: np.ndarray


def _list(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.flatten(), offsets - offsets[0]


def _chunks(symbols: pa.Array, groups: pa.Array, size: int) -> Iterator[Chunk]:
    """All rows in chunks of bounded tokens."""
    values, offsets = _list(symbols)
    flat, lengths = values.to_numpy(), np.diff(offsets)
    begins = _list(groups)[1]
    order = np.argsort(lengths, kind="stable")
    chunk = np.cumsum(lengths[order]) // TOKENS_A_CHUNK
    for own in np.split(order, np.flatnonzero(np.diff(chunk)) + 1) if len(order) else []:
        tokens = np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in own]).astype("int64")
        kinds = begins[own + 1] - begins[own]
        start = np.cumsum(kinds) - kinds
        tokens += np.where(tokens >= size, np.repeat(start, lengths[own]), 0)
        yield Chunk(own, tokens, lengths[own], np.repeat(begins[own] - start, kinds) + np.arange(kinds.sum()))


def packed(counts: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Parts of each row's ``n`` tokens in the states, in 16 bits each, four to a long."""
    parts = np.zeros((len(n), -(-counts.shape[1] // 4) * 4), "<u2")
    parts[:, : counts.shape[1]] = np.rint(np.minimum(counts / np.maximum(n, 1)[:, None], 1.0) * PARTS)
    return [pa.array(x) for x in parts.view("<i8").T]


def unpacked(longs: list[np.ndarray], n: np.ndarray, states: int) -> np.ndarray:
    """Expected counts of n tokens a row."""
    return np.ascontiguousarray(np.stack(longs, axis=1)).view("<u2")[:, :states] * (n / PARTS)[:, None]


def _part(state: int) -> F.Column:
    return F.shiftrightunsigned(f"p{state // 4}", state % 4 * 16).bitwiseAND(PARTS) / PARTS


def baum_welch_round(train: DataFrame, model: Model, alphabet: Alphabet, keep: bool = False) -> tuple[Model, float, DataFrame | None]:
    """One round over all training documents; the tasks' counts are added up by symbol. Also the log-likelihood.

    With ``keep`` also words outside the alphabet, stored: word, c, and p0, p1... as :func:`packed` makes them.
    """
    size, states = model.emit.shape
    first, longs = len(alphabet.words), [f"p{i}" for i in range(-(-states // 4))]
    height = -(-(size + 2 + states) // ROWS_A_BLOCK) * ROWS_A_BLOCK

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows: 0..size-1 emissions, then one for starts, one per state for transitions, one for the likelihood
        total = np.zeros((height, states))

        def rare(words: pa.Array, n: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"word": words, "block": pa.nulls(len(n), pa.int32()), "n": pa.array(n, pa.int64())} | dict(zip(longs, packed(counts, n), strict=True)) | {"sums": pa.nulls(len(n), pa.binary())})

        for batch in batches:
            words, groups = _list(batch.column(1))[0], _list(batch.column(2))[0].to_numpy()
            for c in _chunks(batch.column(0), batch.column(2), size):
                own = groups[c.rare]
                wide = Model(model.start, model.move, np.concatenate([model.emit, model.emit[first + own]]))
                starts, moves, emissions, logs = expected_counts(wide, c.symbols, c.lengths)
                total[:size] += emissions[:size]
                np.add.at(total, first + own, emissions[size:])
                total[size] += starts
                total[size + 1 : size + 1 + states] += moves
                total[size + 1 + states, 0] += logs
                if keep:
                    yield rare(words.take(pa.array(c.rare)), np.bincount(c.symbols, minlength=len(wide.emit))[size:], emissions[size:])
        blocks = total.reshape(-1, ROWS_A_BLOCK * states).astype("<f4")
        used = np.flatnonzero(blocks.any(axis=1))
        nothing = {c: pa.nulls(len(used), pa.int64()) for c in ("n", *longs)}
        yield pa.record_batch({"word": pa.nulls(len(used), pa.binary()), "block": pa.array(used, pa.int32())} | nothing | {"sums": pa.array([b.tobytes() for b in blocks[used]], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0.0) + np.frombuffer(sums, "<f4").astype(float)
        yield pa.record_batch({"block": pa.array(total.keys(), pa.int32()), "sums": pa.array([b.tobytes() for b in total.values()], pa.binary())})

    schema = ", ".join(["word binary, block int, n long", *(f"{c} long" for c in longs), "sums binary"])
    found = train.select("symbols", "rare", "groups").mapInArrow(expect, schema)
    found = stored(found, "lm-expected") if keep else found
    summed = found.where("block is not null").select("block", "sums").repartition("block").mapInArrow(add, "block int, sums binary").toArrow()
    total = np.zeros((height // ROWS_A_BLOCK, ROWS_A_BLOCK * states))
    for block, sums in zip(summed["block"].to_pylist(), summed["sums"].to_pylist(), strict=True):
        total[block] = np.frombuffer(sums)
    total = total.reshape(height, states)
    new, logs = next_model(total[size], total[size + 1 : size + 1 + states], total[:size], alphabet.unigram()), float(total[size + 1 + states, 0])
    if not keep:
        return new, logs, None
    # rows are shuffled as they are, shorter than sums for every state
    by_word = found.where("word is not null").drop("block", "sums").repartition("word").groupBy("word")
    words = by_word.agg(F.sum("n").alias("c"), *[F.sum(_part(i) * F.col("n")).alias(f"s{i}") for i in range(states)])
    part = [F.shiftleft(F.round(F.least(F.col(f"s{i}") / F.col("c"), F.lit(1.0)) * PARTS).cast("long"), i % 4 * 16) for i in range(states)]
    four = [reduce(lambda a, b: a.bitwiseOR(b), part[i : i + 4]).alias(f"p{i // 4}") for i in range(0, states, 4)]
    table = stored(words.select("word", "c", *four), "lm-rare")
    drop_stored(found)
    return new, logs, table


def bucket_number(word: str = "word") -> F.Column:
    """:func:`bucket` for a column."""
    return (F.when(F.octet_length(word) < 3, F.crc32(word)).otherwise(F.crc32(F.substring(word, -3, 3))) % BUCKETS).cast("int")


@dataclass(frozen=True)
class RareWords:
    """Training words outside the alphabet, and of each bucket the states' parts and the sums that shares are divided by."""

    table: DataFrame  # word, c, p0, p1...
    parts: np.ndarray  # BUCKETS x K
    totals: np.ndarray  # BUCKETS x K

    @staticmethod
    def of(table: DataFrame, states: int) -> RareWords:
        own = F.col("c") / (F.col("c") + SHRINK)
        expected, shrunken, others = np.zeros((BUCKETS, states)), np.zeros((BUCKETS, states)), np.full(BUCKETS, 0.5)
        counts = [_part(i) * F.col("c") for i in range(states)]
        sums = [F.sum(e).alias(f"s{i}") for i, e in enumerate(counts)] + [F.sum(own * e).alias(f"own{i}") for i, e in enumerate(counts)]
        for row in table.groupBy(bucket_number().alias("grp")).agg(F.sum((1 - own) * F.col("c") + 0.5).alias("rest"), *sums).collect():
            expected[row["grp"]] = [row[f"s{i}"] for i in range(states)]
            shrunken[row["grp"]] = [row[f"own{i}"] for i in range(states)]
            others[row["grp"]] += row["rest"]
        parts = (expected + 1 / states) / (expected.sum(axis=1, keepdims=True) + 1)
        return RareWords(table, parts, shrunken + parts * others[:, None])

    def shares(self, groups: np.ndarray, c: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """Shares of words within their buckets, by state; c is 0 for words never seen."""
        own, c = (c / (c + SHRINK))[:, None], c[:, None]
        return (own * expected + ((1 - own) * c + 0.5) * self.parts[groups]) / self.totals[groups]


def train(encoded: DataFrame, alphabet: Alphabet, *, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, RareWords]:
    """The model after one round or more, and the words outside the alphabet as the last round counts them."""
    model = first_model(alphabet, states)
    known = encoded.where("not held_out")
    for _ in range(rounds - 1):
        model, _, _ = baum_welch_round(known, model, alphabet)
    model, _, table = baum_welch_round(known, model, alphabet, keep=True)
    return model, RareWords.of(table, states)


def scores(encoded: DataFrame, model: Model, rare: RareWords, alphabet: Alphabet) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every encoded row."""
    (size, states), first = model.emit.shape, len(alphabet.words)
    log_count = np.concatenate([np.log10(alphabet.counts + 0.5), np.zeros(BUCKETS), [np.log10(alphabet.end_count + 0.5)]])
    known = np.concatenate([np.ones(first), np.zeros(BUCKETS), [float(alphabet.end_count > 0)]])
    parts, totals, longs = rare.parts, rare.totals, [c for c in rare.table.columns if c not in ("word", "c")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rare = RareWords(None, parts, totals)
        for batch in batches:
            outs = batch.column(1).to_numpy(zero_copy_only=False)
            values, begins = _list(batch.column(3))
            groups = values.to_numpy()
            met, offsets = _list(batch.column(4))
            at = np.repeat(begins[:-1], np.diff(offsets)) + met.field("at").to_numpy()
            c, expected = np.zeros(len(groups)), np.zeros((len(groups), states))
            c[at] = met.field("c").to_numpy()
            expected[at] = unpacked([met.field(p).to_numpy() for p in longs], c[at], states)
            emit = model.emit[first + groups] * own_rare.shares(groups, c, expected)
            for k in _chunks(batch.column(2), batch.column(3), size):
                wide = Model(model.start, model.move, np.concatenate([model.emit, emit[k.rare]]))
                owner = np.repeat(np.arange(len(k.documents)), k.lengths)
                logs, seen = np.concatenate([log_count, np.log10(c[k.rare] + 0.5)]), np.concatenate([known, c[k.rare] > 0])
                base = np.bincount(owner, logs[k.symbols], len(k.documents)) - k.lengths * alphabet.log_base_total
                n_known = np.bincount(owner, seen[k.symbols], len(k.documents)).astype("int64")
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(pa.array(k.documents)), "held_out": pa.array(outs[k.documents].astype(bool)), "n_tokens": pa.array(k.lengths.astype("int64")),
                    "n_known": pa.array(n_known), "base_score": pa.array(base), "score": pa.array(log10_likelihood(wide, k.symbols, k.lengths)),
                })

    words = encoded.select("row", F.posexplode("rare").alias("at", "word")).join(rare.table, "word")
    met = words.groupBy("row").agg(F.collect_list(F.struct("at", "c", *longs)).alias("met"))
    none = F.array().cast("array<struct<" + ", ".join(["at: int", "c: bigint", *(f"{p}: bigint" for p in longs)]) + ">>")
    whole = encoded.join(met, "row", "left").select("doc_id", "held_out", "symbols", "groups", F.coalesce("met", none).alias("met"))
    scored = whole.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(alphabet.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, training: F.Column | None = None, *, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """The scores of every document, by a model of those that ``training`` names."""
    alphabet = make_alphabet(count_tokens(docs.where(~held_out() if training is None else training)))
    encoded = encode_texts(docs, alphabet)
    return scores(encoded, *train(encoded, alphabet, states=states, rounds=rounds), alphabet)
