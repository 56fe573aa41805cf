"""Packing neighbouring documents into sequences along a Hilbert curve.

Each document's token ids are hashed into BUCKETS signed counts; their logarithms, at length one, are its vector. Random
signs project it to DIMENSIONS whole numbers, which the corpus's means and deviations spread over a grid; the cell's place
on the Hilbert curve is the document's key. Documents are range-sorted by that key, so texts of like words are neighbours,
and the ids of all documents, each with the end id, are one line that is cut every ``length`` ids: only the last sequence
of all is padded.

A range task adds up its own ids as it writes them to the shared folder; one sum a task tells where each begins. Rows of
one key (a third of all texts may be equal) are dealt on by text hash, id and row, so no range is one key.

Defined cases: null text is empty (just the end id); a null doc_id keeps its row; repeated rows are packed each, one after
the other; equal texts are neighbours; texts of any length are encoded whole and cut over as many sequences as they need;
no rows give no rows; columns of any other name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .arrow_ids import ROWS_AT_ONCE, encoder, id_type
from .common import drop_stored, stored

SEQUENCE_LENGTH = 1024
END_ID = 0
BUCKETS, DIMENSIONS, BITS = 1024, 4, 15
#: Vectors are rounded to this many parts, so that projections are exact sums.
PARTS = 1 << 20
#: Documents whose dense vectors are in memory together.
VECTORS_AT_ONCE = 500
AXES = [f"p{i}" for i in range(DIMENSIONS)]


def mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = numbers.astype("uint64") + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of every 16-bit remainder of an id, and the directions of the projection."""
    bits = mixed(np.arange(1 << 16), 1)
    signs = 1 - 2 * (mixed(np.arange(BUCKETS * DIMENSIONS), 2) & np.uint64(1)).astype("float64")
    return (bits % np.uint64(BUCKETS)).astype("int64"), 1.0 - 2.0 * (bits >> np.uint64(63)).astype("float64"), signs.reshape(BUCKETS, DIMENSIONS)


def projections(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole numbers, one row a document: its hashed vector times the directions."""
    bucket, sign, directions = hashing()
    low = ids & 0xFFFF
    cell = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + bucket[low]
    counts = np.bincount(cell, sign[low], len(sizes) * BUCKETS).reshape(len(sizes), BUCKETS)
    vectors = np.sign(counts) * np.log1p(np.abs(counts))
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (np.rint(vectors / np.where(norms > 0, norms, 1) * PARTS) @ directions).astype("int64")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each grid cell (a row of coordinates below 2**bits) on the Hilbert curve."""
    axes = [cells[:, i].astype("int64") for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, coarse to fine
        side, rest = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            flip = (axes[i] & side) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & rest)
            axes[0] = np.where(flip, axes[0] ^ rest, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):  # Gray code over the axes
        axes[i] ^= axes[i - 1]
    turn = np.zeros(len(cells), "int64")
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(len(cells), "int64")
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


def curve_key(encoded: DataFrame) -> F.Column:
    """Projections to curve keys. Means and deviations are of all documents; a logistic curve spreads them over the grid."""
    wanted = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = encoded.agg(*wanted).first()
    middle = np.array([found[f"m{a}"] or 0.0 for a in AXES])
    spread = np.array([found[f"s{a}"] or 1.0 for a in AXES])

    @pandas_udf(LongType())
    def key(axes: pd.DataFrame) -> pd.Series:
        even = 1 / (1 + np.exp(np.clip(-1.702 * (axes.to_numpy("float64") - middle) / spread, -50, 50)))
        return pd.Series(hilbert_keys(np.minimum((even * (1 << BITS)).astype("int64"), (1 << BITS) - 1), BITS))

    return key(F.struct(*AXES))


def encoded_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, th, n, ids (little-endian, of the vocabulary's width) and the projections, one row a document."""
    kind = id_type(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, kind, END_ID)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids, sizes = coder.encode(rows.column(2))
                sizes = sizes.astype("int64")
                ends = np.concatenate([[0], np.cumsum(sizes)])
                packed = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                axes = np.concatenate([projections(ids[ends[a] : ends[min(a + VECTORS_AT_ONCE, len(sizes))]], sizes[a : a + VECTORS_AT_ONCE]) for a in range(0, len(sizes), VECTORS_AT_ONCE)])
                yield pa.record_batch({"doc_id": rows.column(0), "th": rows.column(1), "n": pa.array(sizes), "ids": pa.array(packed, pa.binary())} | {a: pa.array(axes[:, i]) for i, a in enumerate(AXES)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(encode, f"doc_id long, th long, n long, ids binary, {', '.join(f'{a} long' for a in AXES)}")


def along_curve(encoded: DataFrame) -> DataFrame:
    """part, doc_id, n, ids, at: documents in the order of the curve; at is the number of the part's ids before one."""
    order = ["key", "th", "doc_id", "row"]
    rows = encoded.select("doc_id", "th", "n", "ids", curve_key(encoded).alias("key"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            yield batch.append_column("at", pa.array(total + np.cumsum(n) - n, pa.int64()))
            total += int(n.sum())

    return ranged.mapInArrow(add_up, "part int, doc_id long, n long, ids binary, at long")


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = SEQUENCE_LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids of every piece."""
    encoded = stored(encoded_documents(docs, tokenizer_path), "curve-encoded")
    placed = stored(along_curve(encoded), "curve-order")
    drop_stored(encoded)
    before = F.coalesce(F.sum("ids_in").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("part").agg(F.sum("n").alias("ids_in")).select("part", before.alias("base"))
    rows = placed.join(F.broadcast(parts), "part").select("doc_id", "n", (F.col("base") + F.col("at")).alias("at"), "ids")
    width = int(id_type(tokenizer_path)[-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            of = np.repeat(np.arange(len(n)), pieces)
            sequence = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin, end = np.maximum(at[of], sequence * length), np.minimum((at + n)[of], (sequence + 1) * length)
            start, size = begin - at[of], end - begin
            whole = batch.column(3)
            kept, crc, last, ids = [], [], -1, b""
            for k, a, c in zip(of.tolist(), start.tolist(), size.tolist(), strict=True):
                if k != last:
                    ids, last = whole[k].as_py(), k
                kept.append(ids[a * width : (a + c) * width])
                crc.append(zlib.crc32(np.frombuffer(kept[-1], f"<u{width}").astype("<u4").tobytes()))
            out = {"doc_id": batch.column(0).take(pa.array(of)), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[of]), "sequence_id": pa.array(sequence), "offset": pa.array(begin - sequence * length)}
            yield pa.record_batch(out | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens, doc_ids of each sequence, from its pieces (at most as many as it has ids)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("pieces", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("pieces"), F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", joined.alias("ids"), "n_tokens", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"))
