"""Token ids in the Arrow file format.

Each task writes one Arrow IPC file for a contiguous range of doc_id. The file's record batches hold two fixed-size-list
columns, ``ids`` (uint16 if the vocabulary allows, else uint32) and ``mask`` (bool, false for the padding of the file's
last sequence), all sequences of the same length. :class:`SequenceReader` maps the file where it is local: sequence k is
a slice of the mapped buffer, found without reading or copying what lies before it. A second Arrow file beside it names
the documents (doc_id, first id in the file, number of ids), in batches.

Tokenising is cached by piece. The byte-level pre-tokenizer always starts a new piece at a single space before another
character, so texts are cut at spaces, each distinct piece of a batch is encoded by the library unless the worker has it,
and Arrow joins the ids. Texts with two spaces in a row, with white space other than spaces and line feeds, or with a
special token's text are encoded as they are.

Files are written under a temporary name and then moved, so a task that is lost and run again leaves one whole file.
A task holds a batch of rows, a batch of sequences and the bounded cache of pieces, whatever the size of its file.

Defined cases: null text is empty (just the end id); null doc_ids come first; rows of equal doc_id stay neighbours in the
order of a hash of their texts, and may be cut over several files; no rows make no files and give no rows; texts of any
length are encoded whole; columns of any other name are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, stored

SEQUENCE_LENGTH = 2048
SEQUENCES_A_BATCH = 64
END_ID = 2
PIECES_KEPT = 800_000
ROWS_AT_ONCE = 2000
#: New pieces that are given to the tokenizers library as one text, and how byte-level tokens write a space.
PIECES_A_TEXT, BYTE_SPACE = 256, "\u0120"
#: White space other than space and line feed, the four information separators, two spaces, and the start of a special token.
ODD = [*"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000", "  ", "<|"]


def id_type(tokenizer_path: str) -> str:
    """The smaller unsigned type that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


class Encoder:
    """Encodes Arrow text columns to ids; the cache of pieces is bounded and lives as long as the worker."""

    def __init__(self, tokenizer_path: str, kind: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; its threads would contend with them
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer_path), np.dtype(kind)
        self.end = np.array([end_id], self.kind).tobytes()
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids whose bytes begin with a space
        self.spaced[[k for token, k in vocabulary.items() if token.startswith(BYTE_SPACE)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        code = self.kind.char
        return [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space in front, many pieces in one text: the library's work for a text is done once for all.

        A piece without a space inside begins at every id that begins with one. Pieces that are empty or have a line feed
        at an end would form one run of white space with a neighbour's space: they are encoded alone.
        """
        out: list[bytes] = [b""] * len(pieces)
        joint = [k for k, p in enumerate(pieces) if p and p[0] != "\n" != p[-1]]
        blocks = [joint[a : a + PIECES_A_TEXT] for a in range(0, len(joint), PIECES_A_TEXT)]
        texts = [" " + " ".join([pieces[k] for k in block]) for block in blocks]
        alone = [k for k, p in enumerate(pieces) if not (p and p[0] != "\n" != p[-1])]
        for block, coded in zip(blocks, self.whole(texts), strict=True):
            ids = np.frombuffer(coded, self.kind)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(block) or begins[0]:  # a vocabulary that cuts otherwise
                alone += block
                continue
            width = self.kind.itemsize
            bounds = [*(begins * width).tolist(), len(coded)]
            for k, a, b in zip(block, bounds, bounds[1:], strict=False):
                out[k] = coded[a:b]
        for k, coded in zip(alone, self.whole([f" {pieces[k]}" for k in alone]), strict=True):
            out[k] = coded
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, each with the end id, and the number of ids of each text."""
        texts = [t or "" for t in column.to_pylist()]
        odd = [any(c in t for c in ODD) for t in texts]
        parts = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
        offsets = parts.offsets.to_numpy()
        pieces = parts.flatten()
        coded = pieces.dictionary_encode()
        # the part before the first space has none in front; texts with unusual white space take its place as a whole
        first = self.whole([t if o else p for t, o, p in zip(texts, odd, pieces.take(pa.array(offsets[:-1])).to_pylist(), strict=True)])
        later = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.to_numpy().astype("int64")
        index[offsets[:-1]] = len(later) + np.arange(len(first))
        index = np.insert(index, offsets[1:], len(later) + len(first))
        entries = [*later, *first, self.end]
        sizes = np.fromiter(map(len, entries), "int64", len(entries)) // self.kind.itemsize
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        values = pa.array(np.frombuffer(b"".join(entries), self.kind))
        ids = pa.LargeListArray.from_arrays(pa.array(bounds), values).take(pa.array(index)).flatten().to_numpy()
        ends = np.cumsum(sizes[index])[offsets[1:] + np.arange(len(first))]
        return ids, np.diff(ends, prepend=0)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space in front."""
        if len(self.cache) > PIECES_KEPT:  # what this batch needs stays
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        new = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(new, self.together(new), strict=True))
        return [self.cache[p] for p in pieces]


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, kind: str, end_id: int) -> Encoder:
    return Encoder(tokenizer_path, kind, end_id)


#: The table of documents beside a file of sequences.
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _uri(spark: SparkSession, path: str) -> str:
    """With the scheme that Spark would use, in the form that Arrow's file systems read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", whole)


class SequenceFile:
    """Writes ids as batches of equal-length sequences; memory holds one batch."""

    def __init__(self, sink: pa.NativeFile, length: int, kind: str):
        self.length, self.kind = length, np.dtype(kind)
        self.kept = np.zeros(0, self.kind)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        full = self.length * SEQUENCES_A_BATCH
        data = np.concatenate([self.kept, ids])
        for at in range(0, len(data) - full + 1, full):
            self._write(data[at : at + full])
        self.kept = data[len(data) // full * full :]

    def _write(self, data: np.ndarray) -> None:
        padded = np.zeros(-(-len(data) // self.length) * self.length, dtype=self.kind)
        padded[: len(data)] = data
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < len(data))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if len(self.kept):
            self._write(self.kept)
        self.out.close()


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, *, length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest, one row per file: part, path, first_doc, documents, ids.

    Ranges of doc_id are dealt to tasks and sorted there, so part numbers and the order inside a file both ascend.
    """

    kind = id_type(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, kind, end_id)
        state = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                if state is None:
                    store, base = _open(folder)
                    name = f"part-{rows.column(0)[0].as_py():08d}"
                    temporary = f"{base}/_{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                    state = SequenceFile(sink, length, kind)
                    side = store.open_output_stream(f"{temporary}.docs")
                    index, documents, total = pa.ipc.new_file(side, INDEX), 0, 0
                coded, sizes = coder.encode(rows.column(2))
                state.add(coded)
                n = sizes.astype("int64")
                index.write_batch(pa.record_batch([rows.column(1), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=INDEX))
                documents, total = documents + len(n), total + int(n.sum())
        if state is None:
            return
        state.close(), sink.close()
        index.close(), side.close()
        store.move(f"{temporary}.docs", f"{base}/{name}.docs.arrow")
        store.move(temporary, f"{base}/{name}.ids.arrow")
        yield pa.record_batch({"part": pa.array([int(name[5:])], pa.int32()), "path": [f"{folder}/{name}"], "documents": pa.array([documents], pa.int64()), "ids": pa.array([total], pa.int64())})

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    order = ["doc_id", "th", "row"]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return numbered.mapInArrow(write, "part int, path string, documents long, ids long")


class SequenceReader:
    """Random access to one file of sequences; use as a context. Local files are mapped, so nothing is copied."""

    def __init__(self, path: str):
        store, base = _open(path)
        name = f"{base}.ids.arrow"
        self.source = pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length, self.at = self.file.schema.field("ids").type.list_size, -1

    def __enter__(self) -> SequenceReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.source.close()

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.now = k, self.file.get_batch(k)
        return self.now

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence k of the file: its ids and mask, both slices of the file's buffers."""
        got, row = self.batch(k // SEQUENCES_A_BATCH), k % SEQUENCES_A_BATCH * self.length
        ids, mask = (got.column(c).values.slice(got.column(c).offset * self.length + row, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from position ``first``; padding stands only behind a file's last id."""
        size, out = self.length * SEQUENCES_A_BATCH, []
        while count > 0:
            flat = self.batch(first // size).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = flat[first % size : first % size + count]
            out.append(part)
            first, count = first + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "uint16")


def read_documents(manifest: DataFrame, files: int) -> DataFrame:
    """What the files hold, one row per document: doc_id, start, n_tokens, ids_crc32, path. A task reads whole files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base_start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = _open(path)
                with store.open_input_file(f"{base}.docs.arrow") as side, SequenceReader(path) as reader:
                    index = pa.ipc.open_file(side)
                    for docs in map(index.get_batch, range(index.num_record_batches)):
                        first, n = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(reader.ids(int(a), int(c)).astype("<u4").tobytes()) for a, c in zip(first, n, strict=True)]
                        yield pa.record_batch({"doc_id": docs.column("doc_id"), "start": pa.array(first + base_start), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "path": pa.array([path] * len(n))})

    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("start"))
    return placed.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def encode_and_read_back(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, length: int = SEQUENCE_LENGTH) -> DataFrame:
    folder = _uri(spark, fresh_path(spark, "token-ids"))
    manifest = stored(write_ids(docs, folder, tokenizer_path, length=length), "token-manifest")
    return read_documents(manifest, max(manifest.count(), 1))
