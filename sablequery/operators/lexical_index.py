"""A stored positional index of chunks, kept up to date by key.

Folder layout, all Parquet:

* ``postings/segment=N``: a file for each task that cut chunks; nothing is shuffled to write it. Chunks are cut a block at
  a time (some megabytes of text). A row is a term in a block: how many chunks hold it, how often, and parallel arrays with
  an entry for each chunk and column: the chunk's place in the block, the column's number, tf, whether it is the chunk's
  first column with the term, and the positions as differences from one to the next. A block's rows are sorted by term and
  pages are short, so a few terms skip most pages. One more row a block, without a term, lists its chunks by place.
* ``states/v=N``: ``chunks`` (chunk_id, size, digest, segment, block, place), ``terms`` (term, chunks, occurrences; sorted),
  ``dead`` (chunks of older segments that have been replaced or removed) and, written last, ``manifest``. A version without
  a manifest isn't there, so readers see whole versions only, and an update that is lost can be run again.

An update compares digests, tokenises the chunks that are new or changed, and writes them as a segment of their own; old
postings of theirs stay and are left out when read, since places are named by the version's own chunks. Statistics of terms
are corrected by what came and what went. :func:`compact` writes the living postings anew as one segment, in place order:
which places of a block live is one flag a chunk, so that entries are filtered in their rows and never shuffled.

No step gathers a term's postings in one row or group: a row holds a block's at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..functions.text import document_hint
from ..session import shuffles_removed
from . import retrieval as R

#: Up to so many distinct terms a search names them in the scan; beyond, the terms are joined.
NAMED_TERMS = 5000
#: Up to so many rows of them are sent to all tasks that read the index; beyond, its rows are shuffled by term.
SENT_TERMS = 500_000
#: Up to so many distinct words a search without an index sends to its tasks.
SCANNED_TERMS = 500_000
#: Bytes of text in a block, and of those that are words at once.
BLOCK_BYTES, CUT_BYTES = 16 << 20, 4 << 20
#: Rows of a page: the least that a search reads for a term of a block.
PAGE_ROWS = 4000
#: Up to so many chunks (their ids) are sent to all tasks. A block's flags are a byte a chunk, so up to FLAGS times as many.
BROADCAST_CHUNKS, FLAGS = 1_000_000, 32
MANIFEST = "version long, segments array<int>, columns array<string>, id_type string"


@dataclass(frozen=True)
class LexicalIndex:
    """One version of the index under ``path``."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[int, ...]
    columns: tuple[str, ...]
    id_type: str

    def _part(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema.format(id=self.id_type)).parquet(f"{self.path}/states/v={self.version}/{name}")

    def chunks(self) -> DataFrame:
        """chunk_id, size (tokens of all columns), digest, segment, block, place of every chunk, those without tokens too."""
        return self._part("chunks", "chunk_id {id}, size long, digest string, segment int, block string, place int")

    def terms(self) -> DataFrame:
        """term, chunks, occurrences."""
        return self._part("terms", "term string, chunks long, occurrences long")

    def dead(self) -> DataFrame:
        return self._part("dead", "chunk_id {id}, segment int")

    def _stored(self) -> DataFrame:
        rows = self.spark.read.schema(_stored_schema(self.id_type)).parquet(f"{self.path}/postings")
        return rows.where(F.col("segment").isin(*self.segments))

    def stored_blocks(self) -> DataFrame:
        """block, term, chunks, occurrences, places, cols, tfs, leads, deltas, segment of every term in every block; dead entries too."""
        return self._stored().where("term is not null").drop("ids", "sizes", "digests")

    def flagged(self, rows: DataFrame, left: DataFrame) -> DataFrame:
        """rows (block, ...) with ``alive``: for each place of the block whether its chunk is not among left (chunk_id, segment)."""
        placed = self._stored().where("term is null").select("segment", "block", F.posexplode("ids").alias("place", "chunk_id"))
        met = placed.join(_sent(left.select("*", F.lit(False).alias("alive"))), ["chunk_id", "segment"], "left")
        flag = F.struct("place", F.coalesce("alive", F.col("chunk_id").isNotNull()).alias("alive"))
        flags = met.groupBy("block").agg(F.array_sort(F.collect_list(flag))["alive"].alias("alive"))
        return rows.join(F.broadcast(flags) if self.few_flags() else flags, "block")

    def few_flags(self) -> bool:
        return self.chunks().count() + self.dead().count() <= FLAGS * BROADCAST_CHUNKS

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """Living postings: term, chunk_id, col, tf, size, lead (1 for a chunk's first column with the term), deltas; with
        ``terms`` (term, ...) only theirs, each with that row's columns."""
        rows = self.stored_blocks()
        if terms is not None:
            named = [r["term"] for r in terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
            if len(named) <= NAMED_TERMS:
                rows = rows.where(F.col("term").isin(*sorted(named)) if named else F.lit(False))
            # the index is never dealt by term for a few questions
            rows = rows.join(F.broadcast(terms) if terms.count() <= SENT_TERMS else terms, "term")
        names = F.array(*[F.lit(c) for c in self.columns])
        own = ["term", *[c for c in (terms.columns if terms is not None else []) if c != "term"]]
        entries = rows.select(*own, "block", F.inline(F.arrays_zip("places", "cols", "tfs", "leads", "deltas")).alias("place", "col", "tf", "lead", "deltas"))
        # the version's chunks are the living ones
        found = entries.join(self.chunks().select("block", "place", "chunk_id", "size"), ["block", "place"])
        return found.select(*own, "chunk_id", names[F.col("col")].alias("col"), "tf", "size", F.col("lead").cast("int").alias("lead"), "deltas")

    def chunk_sums(self) -> DataFrame:
        """chunk_id, tokens, terms (distinct) of every living chunk with postings, summed from these. Places are summed
        where they are read, before they are named, since a block's rows stand together."""
        entries = self.stored_blocks().select("block", F.inline(F.arrays_zip("places", "tfs", "leads")).alias("place", "tf", "lead"))
        sums = entries.groupBy("block", "place").agg(F.sum("tf").alias("tokens"), F.sum("lead").alias("terms"))
        return sums.join(self.chunks().select("block", "place", "chunk_id"), ["block", "place"]).select("chunk_id", "tokens", "terms")


def _sent(chunks: DataFrame) -> DataFrame:
    """Marked for broadcast if they are few."""
    return F.broadcast(chunks) if chunks.count() <= BROADCAST_CHUNKS else chunks


def _stored_schema(id_type: str) -> str:
    entries = "places array<int>, cols array<tinyint>, tfs array<int>, leads array<tinyint>, deltas array<array<int>>"
    return f"block string, term string, chunks long, occurrences long, {entries}, ids array<{id_type}>, sizes array<bigint>, digests array<string>, segment int"


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


@pandas_udf(LongType())
def phrase_places(words: pd.Series) -> pd.Series:
    """How often the words of a phrase stand in a row, from their shifts and position differences in one field."""

    def count(parts: list) -> int:
        places = None
        for part in parts:
            own = np.cumsum(np.asarray(part["deltas"], "int64")) - part["shift"]
            places = own if places is None else np.intersect1d(places, own, assume_unique=True)
        return 0 if places is None else len(places)

    return words.map(count)


def _digested(chunks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """chunk_id, digest and the indexed columns as text."""
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    marks = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]
    return chunks.select("chunk_id", F.md5(F.concat(*marks)).alias("digest"), *texts)


def _cut(rows: DataFrame, columns: tuple[str, ...], segment: int = 0, only: list[str] | None = None, entries_too: bool = True) -> DataFrame:
    """One row for each term of a block of chunks with its entries, sorted, and one without a term: the block's chunks.

    With ``only`` other terms are left out, entries have ids and sizes instead of places, and the row without a term holds
    how many chunks have tokens, and their tokens.
    """
    id_type = rows.schema["chunk_id"].dataType.simpleString()
    fields = len(columns)
    wanted = None if only is None else pa.array(only, pa.string())

    def words_of(batch: pa.RecordBatch, counts: np.ndarray) -> pa.DictionaryArray:
        words: list[str] = []
        for k, texts in enumerate(zip(*[batch.column(2 + i).to_pylist() for i in range(fields)], strict=True)):
            for i, text in enumerate(texts):
                if text:
                    words += (found := R.fold(text).split())
                    counts[k * fields + i] = len(found)
        return pa.array(words, pa.string()).dictionary_encode()

    def block(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
        own, ids = batch.num_rows, batch.column(0)
        counts, parts, at = np.zeros(own * fields, "int32"), [], 0
        for part in R.sliced(batch, CUT_BYTES, *range(2, 2 + fields)):
            parts.append(words_of(part, counts[at * fields :]))
            at += part.num_rows
        sizes = counts.reshape(own, fields).sum(axis=1, dtype="int64")
        if wanted is None:
            listed = [pa.ListArray.from_arrays(pa.array([0, own], pa.int32()), x) for x in (ids, pa.array(sizes), batch.column(1))]
            whole = pa.record_batch({"block": [name], **dict(zip(("ids", "sizes", "digests"), listed, strict=True))})
        else:
            whole = pa.record_batch({"chunks": pa.array([np.count_nonzero(sizes)]), "occurrences": pa.array([sizes.sum()])})
        yield _filled(whole, rows_schema)
        if not sizes.any():
            return
        coded = pa.chunked_array(parts).unify_dictionaries()
        del parts
        terms = coded.chunk(0).dictionary
        codes = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
        field = np.repeat(np.arange(len(counts), dtype="int32"), counts)
        place = np.arange(len(codes), dtype="int32") - np.repeat((np.cumsum(counts) - counts).astype("int32"), counts)
        if wanted is not None:
            own_words = pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
            codes, field, place = codes[own_words], field[own_words], place[own_words]
            if not len(codes):
                return
        sort = pc.sort_indices(terms)
        terms, ranks = terms.take(sort), np.empty(len(terms), "int32")
        ranks[sort.to_numpy()] = np.arange(len(terms), dtype="int32")
        codes = ranks[codes]
        order = np.argsort(codes, kind="stable")  # fields and places stay in order
        codes, field, place = codes[order], field[order], place[order]
        posted = np.r_[True, (codes[1:] != codes[:-1]) | (field[1:] != field[:-1])]
        first = np.flatnonzero(posted)
        deltas = np.where(posted, place, place - np.r_[0, place[:-1]]).astype("int32")
        tf, chunk, code = np.diff(np.r_[first, len(codes)]), field[first] // fields, codes[first]
        fresh = np.r_[True, code[1:] != code[:-1]]
        lead = (fresh | np.r_[True, chunk[1:] != chunk[:-1]]).astype("int8")
        begun = np.flatnonzero(fresh)
        by_term = {"term": terms.take(pa.array(code[begun])), "chunks": pa.array(np.add.reduceat(lead, begun, dtype="int64")), "occurrences": pa.array(np.add.reduceat(tf, begun))}
        if entries_too:
            cols, ends = (field[first] % fields).astype("int8"), pa.array(np.r_[begun, len(first)].astype("int32"))
            entries = {"cols": cols, "tfs": tf.astype("int32")}
            if wanted is None:
                by_term["block"] = pa.array([name]).take(pa.array(np.zeros(len(begun), "int32")))
                entries |= {"places": chunk, "leads": lead, "deltas": pa.ListArray.from_arrays(pa.array(np.r_[first, len(codes)].astype("int32")), pa.array(deltas))}
            else:
                entries |= {"ids": ids.take(pa.array(chunk)), "sizes": sizes[chunk]}
            by_term |= {k: pa.ListArray.from_arrays(ends, x if isinstance(x, pa.Array) else pa.array(x)) for k, x in entries.items()}
        yield _filled(pa.record_batch(by_term), rows_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in R.sliced(batch, BLOCK_BYTES, *range(2, 2 + fields)):
                yield from block(part, f"{segment}.{task}.{blocks}")
                blocks += 1

    schema = _stored_schema(id_type).rsplit(", segment", 1)[0]
    rows_schema = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(cut, schema)


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """With nulls for the columns that it lacks."""
    have = batch.schema.names
    return pa.record_batch([batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], names=schema.names)


def _write_segment(rows: DataFrame, path: str, segment: int) -> None:
    short = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", str(PAGE_ROWS))
    short.parquet(f"{path}/postings/segment={segment}")


def _segment(spark: SparkSession, path: str, segment: int, id_type: str) -> DataFrame:
    schema = _stored_schema(id_type).replace(", segment int", "")
    return spark.read.schema(schema).parquet(f"{path}/postings/segment={segment}")


def _listed(stored: DataFrame, segment: int) -> DataFrame:
    """The chunks of a segment."""
    rows = F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("place", "row")
    listed = stored.where("term is null").select("block", rows).where("row.ids is not null")
    return listed.select(F.col("row.ids").alias("chunk_id"), F.col("row.sizes").alias("size"), F.col("row.digests").alias("digest"), F.lit(segment).alias("segment"), "block", "place")


def _term_sums(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("chunks").alias("chunks"), F.sum("occurrences").alias("occurrences"))


def _publish(index: LexicalIndex, chunks: DataFrame, terms: DataFrame, dead: DataFrame) -> LexicalIndex:
    """terms: term, chunks, occurrences, once each."""
    base = f"{index.path}/states/v={index.version}"
    for name, part in {"chunks": chunks.select("chunk_id", "size", "digest", "segment", "block", "place"), "terms": terms, "dead": dead.select("chunk_id", "segment")}.items():
        part.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}")
    row = [(index.version, list(index.segments), list(index.columns), index.id_type)]
    # a version that another writer has published meanwhile is an error, not overwritten
    index.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest")
    return index


def _sorted_terms(parts: DataFrame) -> DataFrame:
    return _term_sums(parts).where("chunks > 0").repartitionByRange("term").sortWithinPartitions("term")


def open_index(spark: SparkSession, path: str, version: int | None = None) -> LexicalIndex | None:
    """The newest version, or the one asked for; None if there is none."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/states/*/manifest")
        row = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    except AnalysisException:
        row = None
    return row and LexicalIndex(spark, path, row["version"], tuple(row["segments"]), tuple(row["columns"]), row["id_type"])


def refresh(spark: SparkSession, path: str, chunks: DataFrame, columns: list[str] | None = None) -> LexicalIndex:
    """The index of exactly these chunks (chunk_id once each, never null, and columns): made, brought up to date or left as it is."""
    with shuffles_removed(spark):
        return _refreshed(spark, path, chunks, columns)


def _refreshed(spark: SparkSession, path: str, chunks: DataFrame, columns: list[str] | None) -> LexicalIndex:
    names = tuple(columns or [c for c in R.WEIGHTS if c in chunks.columns])
    digested = _digested(chunks.where("chunk_id is not null"), names)
    id_type = digested.schema["chunk_id"].dataType.simpleString()
    old = open_index(spark, path)
    if old is not None and (old.columns != names or old.id_type != id_type):
        raise ValueError(f"the index holds {old.columns} of {old.id_type} ids, not {names} of {id_type}")
    if old is None:
        _write_segment(_cut(digested, names, 1), path, 1)
        made = _segment(spark, path, 1, id_type)
        own = _listed(made, 1)
        if not own.groupBy("chunk_id").count().where("count > 1").isEmpty():
            raise ValueError("a chunk id stands twice")
        index = LexicalIndex(spark, path, 1, (1,), names, id_type)
        return _publish(index, own, _sorted_terms(made.where("term is not null")), own.where("false"))
    known = old.chunks()
    seen = digested.select("chunk_id", "digest").groupBy("chunk_id").agg(F.min("digest").alias("now"), F.count(F.lit(1)).alias("n"))
    compared = known.join(seen, "chunk_id", "full").select(*known.columns, "now", "n")
    base = f"{path}/states/v={old.version + 1}"
    differs = ~F.coalesce(F.col("digest") == F.col("now"), F.lit(False)) | (F.coalesce(F.col("n"), F.lit(1)) > 1)
    compared.where(differs).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/changes")
    changes = spark.read.parquet(f"{base}/changes")
    told = changes.agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("n") > 1).alias("twice"), F.count("now").alias("fresh"), F.count("segment").alias("gone")).first()
    if told["twice"]:
        raise ValueError("a chunk id stands twice")
    if not told["changes"]:
        return old
    segment = old.version + 1
    gone = changes.where("segment is not null").select("chunk_id", "segment")
    chunks_now = known.join(changes.select("chunk_id"), "chunk_id", "left_anti")
    terms = old.terms()
    if told["gone"]:
        # the living ones among them: a chunk that is gone was alive until now
        entries = F.filter(F.arrays_zip("places", "tfs", "leads"), lambda e: ~F.col("alive")[e["places"]])
        leaving = old.flagged(old.stored_blocks(), gone).where("exists(places, p -> not alive[p])").select("term", entries.alias("e"))
        terms = terms.unionByName(_term_sums(leaving.select("term", (-_total(F.col("e.leads"))).alias("chunks"), (-_total(F.col("e.tfs"))).alias("occurrences"))))
    segments = old.segments
    if told["fresh"]:
        fresh = digested.join(_sent(changes.where("now is not null").select("chunk_id")), "chunk_id", "left_semi")
        _write_segment(_cut(fresh, names, segment), path, segment)
        made = _segment(spark, path, segment, id_type)
        chunks_now = chunks_now.unionByName(_listed(made, segment))
        terms = terms.unionByName(_term_sums(made.where("term is not null")))
        segments = (*segments, segment)
    index = LexicalIndex(spark, path, segment, segments, names, id_type)
    return _publish(index, chunks_now, _sorted_terms(terms), old.dead().unionByName(gone))


def compact(index: LexicalIndex) -> LexicalIndex:
    """The same index in one segment without dead postings, as the next version."""
    with shuffles_removed(index.spark):
        return _compacted(index)


def _compacted(index: LexicalIndex) -> LexicalIndex:
    segment = index.version + 1
    rows, dead = index._stored(), index.dead()
    if not dead.isEmpty():
        rows = index.flagged(rows, dead)
        if not index.few_flags():  # they were shuffled
            rows = rows.sortWithinPartitions("block", "term")
        entries = F.filter(F.arrays_zip("places", "cols", "tfs", "leads", "deltas"), lambda e: F.col("alive")[e["places"]])
        listed = {c: F.transform(c, lambda x, i: F.when(F.col("alive")[i], x)).alias(c) for c in ("ids", "sizes", "digests")}
        left = rows.where("exists(places, p -> alive[p]) or (term is null and exists(alive, x -> x))").select("block", "term", entries.alias("e"), *listed.values())
        parts = [F.col(f"e.{c}").alias(c) for c in ("places", "cols", "tfs", "leads", "deltas")]
        sums = [F.when(F.col("term").isNotNull(), _total(F.col(f"e.{c}"))).alias(n) for c, n in (("leads", "chunks"), ("tfs", "occurrences"))]
        rows = left.select("block", "term", *sums, *parts, *listed)
    _write_segment(rows.drop("segment"), index.path, segment)
    made = LexicalIndex(index.spark, index.path, segment, (segment,), index.columns, index.id_type)
    return _publish(made, index.chunks().withColumn("segment", F.lit(segment)), index.terms().sortWithinPartitions("term"), dead.where("false"))


def prefixed_terms(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes (prefix, ...) with every term that starts with them. They meet by their first characters, three at most."""
    keyed = prefixes.withColumn("head", F.substring("prefix", 1, 3))
    lengths = [r["n"] for r in keyed.select(F.length("head").alias("n")).distinct().collect()]
    if not lengths:
        return terms.join(prefixes, F.lit(False))
    heads = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in sorted(lengths)]))).alias("head")
    return terms.select("*", heads).join(keyed, "head").where(F.col("term").startswith(F.col("prefix"))).drop("head")


def phrase_hits(index: LexicalIndex, words: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_id, col, size, tf: how often a token's words stand in a row. words: keys, size (of the token), shift, term."""
    rows = index.postings(words.withColumnRenamed("size", "words"))
    fields = rows.groupBy(*keys, "words", "chunk_id", "col").agg(F.count_distinct("shift").alias("n"), F.max("size").alias("size"), F.collect_list(F.struct("shift", "deltas")).alias("parts"))
    return fields.where("n = words").withColumn("tf", phrase_places("parts")).where("tf > 0").select(*keys, "chunk_id", "col", "size", "tf")


def token_volumes(index: LexicalIndex, tokens: DataFrame) -> DataFrame:
    """token, volume: chunks with an exact token, from the statistics if it is one word; the sum over the terms under a prefix."""
    distinct = tokens.select("token", "exact").distinct()
    prefixes = distinct.where("not exact").select(F.col("token").alias("prefix"))
    by_prefix = prefixed_terms(index.terms(), prefixes).groupBy(F.col("prefix").alias("token")).agg(F.sum("chunks").alias("volume"))
    words = R.token_words(distinct.where("exact"), "token")
    single = words.where("size = 1").join(index.terms(), "term").select("token", F.col("chunks").alias("volume"))
    phrases = phrase_hits(index, words.where("size > 1"), "token").groupBy("token").agg(F.count_distinct("chunk_id").alias("volume"))
    return by_prefix.unionByName(single).unionByName(phrases)


def weighted_hits(index: LexicalIndex, tokens: DataFrame, weights: dict[str, float] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """query_id, token, chunk_id, size, f: weighted occurrences of each selected token in each chunk that it reaches."""
    keys = ["query_id", "token"]
    words = R.token_words(tokens, *keys, "exact")
    one = words.where("size = 1")
    prefixes = one.where("not exact").select(*keys, F.col("term").alias("prefix"))
    terms = keep(one.where("exact").select(*keys, "term").unionByName(prefixed_terms(index.terms().select("term"), prefixes).select(*keys, "term")))
    plain = index.postings(terms).select(*keys, "chunk_id", "col", "size", "tf")
    several = phrase_hits(index, words.where("size > 1").drop("exact"), *keys).select(*keys, "chunk_id", "col", "size", "tf")
    return _weighted(plain.unionByName(several), weights)


def _weighted(found: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for pair in (weights or R.WEIGHTS).items() for x in pair])[F.col("col")]
    return found.groupBy("query_id", "token", "chunk_id").agg(F.sum(F.coalesce(weight, F.lit(1.0)) * F.col("tf")).alias("f"), F.max("size").alias("size"))


def scores(index: LexicalIndex, hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score as :func:`retrieval.bm25` gives it. hits are read twice: store them."""
    corpus = index.chunks().where("size > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    return _scored(hits, corpus["n"], corpus["mean"])


def _scored(hits: DataFrame, n: int, mean: float | None) -> DataFrame:
    reach = hits.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("reach"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - F.col("reach") + 0.5) / (F.col("reach") + 0.5)))
    part = idf * F.col("f") * (R.K1 + 1) / (F.col("f") + R.K1 * (1 - R.B + R.B * F.col("size") / F.lit(mean or 1.0)))
    return hits.join(reach, ["query_id", "token"]).groupBy("query_id", "chunk_id").agg((-F.sum(part)).alias("score"))


def scanned_scores(chunks: DataFrame, columns: list[str], words: DataFrame, most: int, weights: dict[str, float] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
    """query_id, chunk_id, score by the ``most`` rarest of each query's words (query_id, term), searched exactly, without an index.

    For questions that are asked once: chunks are read twice, first to count the words that are asked for, then for the
    postings of those chosen. Nothing else of the text leaves the task that cuts it. The words are sent to all tasks;
    None if they are more than SCANNED_TERMS.
    """
    words = keep(words.distinct())

    def listed(frame: DataFrame) -> list[str]:
        return [r["term"] for r in frame.select("term").distinct().limit(SCANNED_TERMS + 1).collect()]

    named = listed(words)
    if len(named) > SCANNED_TERMS:
        return None
    names = tuple(columns)
    rows = chunks.where("chunk_id is not null").select("chunk_id", F.lit("").alias("digest"), *[F.col(c).cast("string").alias(c) for c in names])
    counted = keep(_term_sums(_cut(rows, names, only=named, entries_too=False)))
    corpus = counted.where("term is null").first()
    n, tokens = (corpus["chunks"], corpus["occurrences"]) if corpus else (0, 0)
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy("chunks", "term"))
    chosen = keep(words.join(counted.select("term", "chunks"), "term").withColumn("n", rarest).where(F.col("n") <= most).select("query_id", "term"))
    cut = _cut(rows, names, only=listed(chosen)).where("term is not null").join(F.broadcast(chosen), "term")
    entries = F.inline(F.arrays_zip("ids", "cols", "tfs", "sizes")).alias("chunk_id", "col", "tf", "size")
    found = cut.select("query_id", F.col("term").alias("token"), entries).withColumn("col", F.array(*[F.lit(c) for c in names])[F.col("col")])
    return _scored(keep(_weighted(found, weights)), n, tokens / n if n else None)


def named_chunks(chunks: DataFrame, hints: DataFrame) -> DataFrame:
    """query_id, chunk_id of the chunks of documents that questions name, by file name or by the title's beginning."""
    asked = hints.where("hint is not null").select("query_id", F.upper("hint").alias("name"))
    file = F.regexp_extract(F.upper(F.element_at(F.split("source_path", "/"), -1)), r"^(.*)\.HTML$", 1)
    title = F.when(F.col("title").contains(" - "), F.upper(F.substring_index("title", " - ", 1)))
    names = chunks.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.array(F.nullif(file, F.lit("")), title)))).alias("name"))
    return names.join(asked, "name").select("query_id", "chunk_id").distinct()


def search_index(index: LexicalIndex, questions: DataFrame, chunks: DataFrame, k: int, *, vectors: DataFrame | None = None, vector_queries: DataFrame | None = None, relationships: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame | None]:
    """:func:`retrieval.search` over the stored index; ``keep`` stores selected tokens, hits and the best.

    Only statistics of terms are read to choose tokens, and only the chosen terms' buckets to score. Chunks are joined
    to the best of each question, not to all hits. A chunk of either arm that ``chunks`` lacks is an error.
    """
    k = max(1, min(k, R.MOST_RESULTS))
    depth = k * R.HYBRID_DEPTH if vectors is not None else k
    asked = keep(R.asked_tokens(questions))
    chosen = keep(R.select_tokens(asked, token_volumes(index, asked)).select("query_id", "token", "exact"))
    scored = scores(index, keep(weighted_hits(index, chosen, keep=keep)))
    hints = questions.select("query_id", document_hint(F.col("question")).alias("hint"))
    named = named_chunks(chunks, hints).withColumn("document_rank", F.lit(0))
    ordered = scored.join(named, ["query_id", "chunk_id"], "left").na.fill(1, ["document_rank"])
    pool = R.hydrate(keep(R.ranked(ordered, depth * R.POOL, F.col("document_rank").asc(), F.col("score").asc())), chunks.select("chunk_id", "source_path")).join(hints, "query_id", "left")
    lexical = R.diverse(pool, depth, exempt=F.upper("source_path") == F.col("hint"))
    best = lexical if vectors is None else R.fuse(lexical, R.dense_top(vectors, vector_queries, depth), k=k)
    found = R.hydrate(keep(best.select("query_id", "chunk_id", "rank")), chunks)
    if relationships is None:
        return found, None
    seeds = found.groupBy("query_id", "doc_id").agg(F.min("rank").alias("seed_rank"))
    return found, R.expand_one_hop(seeds.join(questions, "query_id"), relationships, F.col("question"))
