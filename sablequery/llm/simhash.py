"""SimHash near-duplicates: pigeonhole blocks, joined, then verified by Hamming distance.

A fingerprint's bit is 1 if it is set in more than half of the hashes of the text's 4-word shingles. Fingerprints at
DISTANCE or fewer differing bits are linked, and links are followed to connected components.

Search is over distinct fingerprints, so exact copies cost nothing. The 64 bits are cut into BLOCKS blocks; two
fingerprints that differ in at most DISTANCE bits agree on at least BLOCKS - DISTANCE of them, so each choice of that
many blocks gives a key and every linked pair shares a key. Fingerprints meet by key and the distance is verified.

Groups are never expanded into all their pairs: a key of more than REKEYED fingerprints is split by a second choice of
blocks, made of other bits, which any linked pair shares as well; what a key holds then is dealt into parts of about
PART, each pair of parts is one array row of bounded size, and of the verified links inside an array only a spanning
forest is written, which keeps every connection. Nothing is dropped. The number of blocks follows the number of distinct
fingerprints, so that a key holds few of them by chance; the result is the same for any number.

A class of equal fingerprints is known by its first row (smallest doc_id), and components are labelled by the first row
of all, so the smallest doc_id comes out of the contraction itself and no component is ever gathered.

Defined cases: null and blank texts have fingerprint zero, linked like any other; rows of equal doc_id are documents of
their own; a null doc_id keeps its row, and component_id is the smallest id that is not null (null if there is none);
texts are taken whole at any length; no rows give no rows; other columns, of whatever names, are ignored and kept by
the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free_name, join_hot, map_batches, stored, utf8_bytes
from .components import connected_components

WORDS, SEED, DISTANCE = 4, 42, 4
PART = 2048
REKEYED = 16 * PART
#: Rows that stay are broadcast (some 40 bytes each) up to this number, else joined by shuffle.
BROADCAST_KEPT = 1_000_000
#: Distinct fingerprints up to which a number of blocks is used: keys of 21, 27 and 32 bits.
BLOCKS_UP_TO = {6: 1 << 25, 7: 1 << 31, 8: 1 << 63}


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included; a shorter text is one shingle."""
    own = text.translate(ASCII_LOWER).split()
    if not own:
        return np.zeros(0, "uint64")
    joined, n = b" ".join(own), max(len(own) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, own), "int64", len(own)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(own)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "uint64", n)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and fp (fingerprint, long) of every row."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(x)) for x in utf8_bytes(batch.column(2))]
        return pa.record_batch({"doc_id": batch.column(0), "th": batch.column(1), "fp": pa.array(found, pa.int64())})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), encode, "doc_id long, th long, fp long")


def block_keys(fp: str = "fp", blocks: int = 6, distance: int = DISTANCE, scattered: bool = False) -> F.Column:
    """An array with a key (number of the choice, masked fingerprint) for each choice of blocks that may agree.

    A block is a run of bits or, if ``scattered``, every bit whose number leaves the same remainder.
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in (range(k, 64, blocks) if scattered else range(edges[k], edges[k + 1]))) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).cast("byte").alias("n"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Breadth first from each unvisited value: every value is compared once with those not yet reached."""
    left, links = values, []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                waiting += list(found)
                left = left[~near]
    return links


def links(distinct: DataFrame, *, blocks: int | None = None, distance: int = DISTANCE, part: int = PART, rekeyed: int = REKEYED) -> DataFrame:
    """a, b: enough verified links between distinct fingerprints (column fp) to connect all that are linked."""
    if blocks is None:
        count = distinct.count()
        blocks = next(n for n, most in BLOCKS_UP_TO.items() if count <= most)
    names = ["n", "bits", "n2", "bits2"]

    def sized(keyed: DataFrame, name: str) -> DataFrame:
        shared = stored(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), name)
        return keyed.join(shared, names)

    keyed = distinct.select("fp", F.explode(block_keys("fp", blocks, distance)).alias("key")).select("fp", "key.n", "key.bits", F.lit(0).cast("byte").alias("n2"), F.lit(0).cast("long").alias("bits2"))
    first = sized(keyed, "simhash-keys")
    split = first.where(F.col("size") > rekeyed).select("fp", "n", "bits", F.explode(block_keys("fp", blocks, distance, scattered=True)).alias("key")).select("fp", "n", "bits", F.col("key.n").alias("n2"), F.col("key.bits").alias("bits2"))
    met = first.where(F.col("size") <= rekeyed).unionByName(sized(split, "simhash-keys")).withColumn("parts", F.ceil(F.col("size") / F.lit(part)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = met.select("fp", *names, own.alias("own"), other).select("fp", *names, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    arrays = dealt.groupBy(*names, "low", "high").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(0).flatten().to_numpy().view("uint64"), batch.column(0).offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]  # most arrays are pairs
            near = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= distance]
            a, b = [flat[near].view("int64")], [flat[near + 1].view("int64")]
            for k in np.flatnonzero(sizes > 2):
                found = _spanning(flat[offsets[k] : offsets[k + 1]], distance)
                if found:
                    pairs = np.array(found, dtype="uint64").view("int64")
                    a.append(pairs[:, 0]), b.append(pairs[:, 1])
            yield pa.record_batch({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return arrays.mapInArrow(verify, "a long, b long")


def components(marked: DataFrame, *, blocks: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """Stored: fp, copies, own and component of every distinct fingerprint of ``marked`` (doc_id, th, fp).

    own and component are the first rows (no_id, doc_id, th, fp) of the fingerprint and of its whole component.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "fp")
    classes = stored(marked.groupBy("fp").agg(F.min(row).alias("own"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    edges = stored(links(classes, blocks=blocks, distance=distance), "simhash-links")
    for end in "ab":
        edges = edges.join(classes.select(F.col("fp").alias(end), F.col("own").alias(f"{end}_own")), end)
    found = connected_components(edges, "a_own", "b_own").select("node.fp", "component")
    return stored(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "own")), "simhash-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    marked = stored(fingerprints(docs), "simhash-fps")
    found = components(marked).select("fp", "copies", F.col("component.doc_id").alias("component_id"))
    joined = join_hot(marked.select("doc_id", "fp"), found, "fp", "copies", marked.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, null last; of its repeated rows one stays.

    A row is known by doc_id and a hash of its text, so fingerprints are made once; texts are only shuffled if more rows
    stay than may be broadcast, and where a row that stays is repeated.
    """
    marked = stored(fingerprints(docs), "simhash-fps")
    first = components(marked).where("own = component").select("own.doc_id", "own.th")
    key, th = free_name(docs, "key"), free_name(docs, "th")
    own_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key)
    rows = marked.groupBy(own_key, F.col("th").alias(th)).count()
    kept = stored(first.select(own_key, F.col("th").alias(th)).join(rows, [key, th]), "simhash-kept")
    few = F.broadcast if kept.count() <= BROADCAST_KEPT else lambda df: df
    keyed = docs.select("*", own_key, F.xxhash64("text").alias(th))
    out = keyed.join(few(kept.where("count = 1").drop("count")), [key, th], "left_semi")
    repeated = kept.where("count > 1").drop("count")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(few(repeated), [key, th], "left_semi").dropDuplicates([key, th]))
    return out.select(*docs.columns)
