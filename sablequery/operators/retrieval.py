"""Lexical, dense and hybrid retrieval over DataFrames.

The lexical index is two relations: postings (term, chunk_id, col, position) and chunk sizes. Queries are a relation
too (query_id, term, exact), so one job answers any number of them: terms meet postings in a join, and everything
after that is grouped by query and chunk. Ties are broken by chunk_id, so ranks never depend on partitioning.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from ..functions.text import SHORT_TERMS, document_hint, overlap_tokens, query_token

#: BM25 weights of the indexed columns.
WEIGHTS = {"chunk_id": 0.0, "source_path": 8.0, "title": 10.0, "category": 0.5, "heading_path": 5.0, "text": 1.0, "generated_queries": 0.5}
K1, B = 1.2, 0.75
QUERIES_A_BLOCK, QUERIES_AT_ONCE, VECTORS_AT_ONCE = 20_000, 64, 2048
MOST_TOKENS, POOL, HYBRID_DEPTH, PER_DOCUMENT, RRF_CONSTANT, MOST_RESULTS = 8, 4, 2, 3, 60, 25


class _Folding(dict):
    """What each character of decomposed text becomes, looked up once per character."""

    def __missing__(self, code: int) -> str | None:
        sign = chr(code)
        kind = unicodedata.category(sign)
        found = self[code] = sign if kind[0] in "LN" or kind == "Co" else None if kind == "Mn" else " "
        return found


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Case and accents folded; what is no letter, digit or private-use sign becomes a space."""
    return unicodedata.normalize("NFD", text).translate(_FOLDING).lower()


def sliced(batch: pa.RecordBatch, most: int, *columns: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, in parts whose texts (those columns) have ``most`` bytes or a little more."""
    lengths = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), "int64") for c in columns)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        yield batch.slice(at, end - at)
        at = end


@pandas_udf(ArrayType(StringType()))
def index_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fold(t).split() if t else [])


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(fold(t).split()) if t else "")


def field_tokens(text: F.Column) -> F.Column:
    """:func:`index_tokens` for long texts: a worker holds one string a text, which is cut outside it."""
    return F.filter(F.split(folded(text), " "), lambda t: t != "")


def indexed_fields(chunks: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """chunk_id, fields: the tokens of each indexed column, one row a chunk."""
    names = list(columns or [c for c in WEIGHTS if c in chunks.columns])
    return chunks.select("chunk_id", F.array(*[F.struct(F.lit(c).alias("col"), field_tokens(F.col(c).cast("string")).alias("tokens")) for c in names]).alias("fields"))


def field_postings(fields: DataFrame) -> DataFrame:
    """The postings of an index kept as :func:`indexed_fields`."""
    return fields.select("chunk_id", F.explode("fields").alias("f")).select("chunk_id", "f.col", F.posexplode("f.tokens").alias("position", "term"))


def field_sizes(fields: DataFrame) -> DataFrame:
    """:func:`chunk_sizes` of such an index."""
    tokens = F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["tokens"]))
    return fields.select("chunk_id", tokens.cast("long").alias("size")).where("size > 0")


def field_vocabulary(fields: DataFrame) -> DataFrame:
    """:func:`vocabulary` of such an index: a chunk's terms are made distinct in place, so only counts are shuffled."""
    terms = F.array_distinct(F.flatten(F.transform("fields", lambda f: f["tokens"])))
    return fields.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("chunks"))


def postings(chunks: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """chunk_id, col, position, term for every token of the indexed columns."""
    names = list(columns or [c for c in WEIGHTS if c in chunks.columns])
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in names])).alias("f")
    tokens = chunks.select(F.col("chunk_id").alias("chunk_id"), fields).select("chunk_id", "f.col", index_tokens("f.value").alias("tokens"))
    return tokens.select("chunk_id", "col", F.posexplode("tokens").alias("position", "term"))


def chunk_sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("size"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """term, chunks: in how many chunks each term stands."""
    return posted.groupBy("term").agg(F.count_distinct("chunk_id").alias("chunks"))


def query_tokens(question: str) -> list[str]:
    """Searchable tokens in order, each once."""
    return list(dict.fromkeys(t for raw in re.findall(r"\w+", question) if (t := query_token(raw))))


@pandas_udf(ArrayType(StringType()))
def question_tokens(question: pd.Series) -> pd.Series:
    return question.map(lambda q: query_tokens(q) if q else [])


def asked_tokens(questions: DataFrame) -> DataFrame:
    """query_id, place, token, exact, identifier of every token of questions (query_id, question)."""
    tokens = questions.select("query_id", F.posexplode(question_tokens("question")).alias("place", "token"))
    named = F.col("token").contains("_") | (F.col("token").rlike(r"(?U)\d") & F.col("token").rlike(r"\p{L}"))
    exact = named | F.col("token").rlike(r"^(?U)\d+$") | F.col("token").isin(*sorted(SHORT_TERMS))
    return tokens.withColumns({"identifier": named, "exact": exact})


def under_prefix(vocab: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes (prefix, ...) with every term of the vocabulary that starts with them. Heads of terms are compared for equality."""
    longest = prefixes.agg(F.max(F.length("prefix")).alias("longest"))
    ends = F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.col("longest"))))
    heads = vocab.crossJoin(F.broadcast(longest)).withColumn("end", ends).withColumn("prefix", F.substring("term", F.lit(1), F.col("end"))).drop("end", "longest")
    return heads.join(prefixes, "prefix")


def phrase_starts(posted: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_id, col, start: one row per place where a phrase's words stand in a row. parts: keys, size, shift, term of each word."""
    runs = posted.join(parts, "term").groupBy(*keys, "size", "chunk_id", "col", (F.col("position") - F.col("shift")).alias("start")).agg(F.count_distinct("shift").alias("n"))
    return runs.where(F.col("n") == F.col("size")).select(*keys, "chunk_id", "col", "start")


def token_words(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, size, shift, term of each word that the index makes of a token."""
    words = tokens.select(*keys, index_tokens("token").alias("words"))
    return words.select(*keys, F.size("words").alias("size"), F.posexplode("words").alias("shift", "term"))


def token_volumes(tokens: DataFrame, posted: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, volume: chunks that hold an exact token's words in a row, or the sum over the terms with a prefix."""
    distinct = tokens.select("token", "exact").distinct()
    prefixes = distinct.where("not exact").select(F.col("token").alias("prefix"))
    by_prefix = under_prefix(vocab, prefixes).groupBy(F.col("prefix").alias("token")).agg(F.sum("chunks").alias("volume"))
    starts = phrase_starts(posted, token_words(distinct.where("exact"), "token"), "token")
    return by_prefix.unionByName(starts.groupBy("token").agg(F.count_distinct("chunk_id").alias("volume")))


def select_tokens(tokens: DataFrame, volumes: DataFrame, limit: int = MOST_TOKENS) -> DataFrame:
    """At most ``limit`` tokens of each query that match anything: identifiers first, then the rarest. place keeps their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("identifier"), F.when(F.col("identifier"), 0).otherwise(F.col("volume")), "place")
    alive = tokens.join(volumes.where("volume > 0"), "token")
    return alive.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def token_hits(posted: DataFrame, tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """query_id, token, chunk_id, col, tf for selected tokens (query_id, token, exact; at most MOST_TOKENS a query).

    A token of several words counts where they stand in a row, any other by its word or, if not exact, by each term
    that starts with it.
    """
    keys = ["query_id", "token"]
    words = token_words(tokens, *keys, "exact")
    several, one = words.where("size > 1"), words.where("size = 1")
    prefixes = one.where("not exact").select(*keys, F.col("term").alias("prefix"))
    terms = one.where("exact").select(*keys, "term").unionByName(under_prefix(vocab, prefixes).select(*keys, "term"))
    plain = posted.join(terms, "term").select(*keys, "chunk_id", "col")
    phrases = phrase_starts(posted, several.drop("exact"), *keys).select(*keys, "chunk_id", "col")
    return plain.unionByName(phrases).groupBy(*keys, "chunk_id", "col").agg(F.count(F.lit(1)).alias("tf"))


def bm25(hits: DataFrame, sizes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, chunk_id, score (negative, lower is better) of every chunk that any token reaches."""
    weight = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])[F.col("col")]
    corpus = F.broadcast(sizes.agg(F.count(F.lit(1)).cast("double").alias("n_chunks"), F.avg("size").alias("mean_size"), F.lit(1).alias("one")))
    by_chunk = hits.groupBy("query_id", "token", "chunk_id").agg(F.sum(F.coalesce(weight, F.lit(1.0)) * F.col("tf")).alias("f"))
    reach = by_chunk.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("reach"))
    rows = by_chunk.join(reach, ["query_id", "token"]).join(sizes, "chunk_id").withColumn("one", F.lit(1)).join(corpus, "one")
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_chunks") - F.col("reach") + 0.5) / (F.col("reach") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return rows.groupBy("query_id", "chunk_id").agg((-F.sum(part)).alias("score"))


def ranked(scores: DataFrame, k: int, *order: F.Column) -> DataFrame:
    """The k best of each query with rank 1..k."""
    best = Window.partitionBy("query_id").orderBy(*(order or (F.col("score").asc(),)), F.col("chunk_id").asc())
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_hint(scores: DataFrame, chunks: DataFrame, hints: DataFrame) -> DataFrame:
    """Adds document_rank: 0 for chunks of the document that the query names, else 1. hints: query_id, hint."""
    named = scores.join(chunks.select("chunk_id", "source_path", "title"), "chunk_id").join(hints, "query_id", "left")
    path, hint = F.upper("source_path"), F.col("hint")
    hit = (path == F.concat(hint, F.lit(".HTML"))) | path.endswith(F.concat(F.lit("/"), hint, F.lit(".HTML"))) | F.upper("title").startswith(F.concat(hint, F.lit(" - ")))
    return named.withColumn("document_rank", F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1))


def diverse(rows: DataFrame, k: int, cap: int = PER_DOCUMENT, exempt: F.Column | None = None) -> DataFrame:
    """At most ``cap`` rows a document first, in rank order, then the others in rank order; k rows a query. rows: query_id, rank, source_path."""
    if cap < 1:
        return rows.where(F.col("rank") <= k)
    within = F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy("rank"))
    over = (within > cap) & ~F.coalesce(exempt, F.lit(False)) if exempt is not None else within > cap
    marked = rows.withColumn("__over", over)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("__over", "rank"))
    return marked.withColumn("place", place).where(F.col("place") <= k).drop("__over", "rank").withColumnRenamed("place", "rank")


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: str) -> F.Column:
    """The vector at length one; null if it has no length or a part that is no number."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sound = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(sound, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float")))


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this length and finite numbers only, and these as doubles."""
    own = np.flatnonzero(np.asarray(column.value_lengths().fill_null(0)) == dimensions)
    numbers = column.take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    sound = np.isfinite(numbers).all(axis=1)
    return own[sound], numbers[sound]


def _rounded(numbers: np.ndarray, digits: int) -> np.ndarray:
    """To that many digits, halves away from zero."""
    scaled = np.abs(numbers) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, numbers) + 0.0


def _best_products(asked: np.ndarray, numbers: np.ndarray, order: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and score of each query's best k. A matrix product finds candidates; their scores are summed
    in order, so that equal vectors have equal scores, and rounded to ``digits``; ``order`` then breaks ties."""
    products = asked @ numbers.T
    least = np.partition(products, -k, axis=1)[:, -k] if k < products.shape[1] else np.full(len(asked), -np.inf)
    slack = 1e-14 * asked.shape[1] * np.sqrt((asked**2).sum(axis=1)) * np.sqrt((numbers**2).sum(axis=1).max())
    if digits is not None:  # what rounds to the same score is a candidate too
        slack = slack + 1.01 * 10.0**-digits
    query, vector = np.nonzero(products >= (least - slack)[:, None])
    score = np.cumsum(asked[query] * numbers[vector], axis=1)[:, -1]
    if digits is not None:
        score = _rounded(score, digits)
    sort = np.lexsort((order[vector], -score, query))
    place = np.arange(len(sort)) - np.searchsorted(query[sort], query[sort])
    kept = sort[place < k]
    return query[kept], vector[kept], score[kept]


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df, digits: int | None = None) -> DataFrame:
    """Exact inner-product top k. vectors: chunk_id, embedding; queries: query_id, query (a stated set, met in blocks).

    A task multiplies its vectors, a few thousand at a time, with a block of queries and sends the best k of each product;
    partitions keep their own best k of every query before the shuffle. Vectors and queries of another length than the
    block's, or with numbers that are missing or not finite, have no score. With ``keep``, which stores a frame, a block's
    matrix leaves the driver before the next comes. With ``digits`` scores are rounded before they are ranked.
    """
    blocks = max(1, -(-queries.count() // QUERIES_A_BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    kinds = {c: frame.schema[c].dataType.simpleString() for frame, c in ((queries, "query_id"), (vectors, "chunk_id"))}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    id_type = to_arrow_type(queries.schema["query_id"].dataType)

    def met(number: int) -> DataFrame:
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        rows = block.where("query is not null").select("query_id", "query").collect()
        groups = []
        for size in sorted({len(r["query"]) for r in rows} - {0}):
            own = [r for r in rows if len(r["query"]) == size]
            asked = np.array([r["query"] for r in own], "float64")
            sound = np.isfinite(asked).all(axis=1)
            groups.append((pa.array([r["query_id"] for r in own], id_type).filter(pa.array(sound)), asked[sound]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, VECTORS_AT_ONCE):
                    batch = whole.slice(at, VECTORS_AT_ONCE)
                    for names, asked in groups:
                        own, numbers = _matrix(batch.column(1), asked.shape[1])
                        ids = batch.column(0).take(pa.array(own))
                        if not len(own):
                            continue
                        order = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()
                        for start in range(0, len(asked), QUERIES_AT_ONCE):
                            query, vector, found = _best_products(asked[start : start + QUERIES_AT_ONCE], numbers, order, k, digits)
                            yield pa.record_batch({"query_id": names.take(pa.array(query + start)), "chunk_id": ids.take(pa.array(vector)), "score": pa.array(found)})

        scored = vectors.select("chunk_id", "embedding").mapInArrow(score, schema)
        return keep(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    return reduce(DataFrame.unionByName, map(met, range(blocks)))


def fuse(*lists: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, chunk_id, rank): score = sum of 1 / (60 + rank)."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    placed = fused.withColumn("rank", F.row_number().over(best))
    return placed if k is None else placed.where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """Hits with their chunks. With ``strict`` a hit without a chunk fails the query as it runs, else it is left out."""
    if not strict:
        return hits.join(chunks, "chunk_id")
    joined = hits.join(chunks.withColumn("__there", F.lit(True)), "chunk_id", "left")
    missing = F.raise_error(F.concat(F.lit("a hit is missing from the index: "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))))
    return joined.withColumn("chunk_id", F.when(F.col("__there"), F.col("chunk_id")).otherwise(missing.cast(hits.schema["chunk_id"].dataType))).drop("__there")


def resolve_destinations(relationships: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds target_doc_id: the document whose file name is the target table's, smallest path first; else null."""
    named = docs.select(F.upper(F.element_at(F.split("source_path", "/"), -1)).alias("file"), "doc_id", "source_path")
    first = named.groupBy("file").agg(F.min_by("doc_id", "source_path").alias("target_doc_id"))
    keyed = relationships.drop("target_doc_id").withColumn("file", F.concat(F.upper("target_table"), F.lit(".HTML")))
    return keyed.join(first, "file", "left").drop("file")


def expand_one_hop(seeds: DataFrame, relationships: DataFrame, question: F.Column | None = None, most: int = 5) -> DataFrame:
    """Neighbours of each query's seed documents, the best edge of each, ``most`` a query.

    seeds: query_id, doc_id, seed_rank. Better: more words shared with the question, then seed rank, ordinal, edge id.
    """
    columns = ["relationship_id", "source_doc_id", "target_doc_id", "source_table", "target_table", "source_column", "target_column", "ordinal"]
    edges = relationships.where("target_doc_id is not null").select(*columns)
    out = edges.withColumns({"doc_id": F.col("source_doc_id"), "neighbour": F.col("target_doc_id"), "neighbour_table": F.col("target_table"), "direction": F.lit("outbound")})
    # an edge from a document to itself counts once, as outbound
    into = edges.where("source_doc_id <> target_doc_id").withColumns({"doc_id": F.col("target_doc_id"), "neighbour": F.col("source_doc_id"), "neighbour_table": F.col("source_table"), "direction": F.lit("inbound")})
    met = out.unionByName(into).join(seeds, "doc_id")
    met = met.join(seeds.select("query_id", F.col("doc_id").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
    words = overlap_tokens(F.concat_ws(" ", "neighbour_table", "source_column", "target_column"))
    overlap = F.size(F.array_intersect(words, overlap_tokens(question))) if question is not None else F.lit(0)
    key = F.struct((-overlap).alias("o"), "seed_rank", F.col("ordinal").isNull().alias("no"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "relationship_id")
    best = met.withColumn("__key", key).groupBy("query_id", "neighbour").agg(F.min_by(F.struct("relationship_id", "direction", "seed_rank", "doc_id"), "__key").alias("edge"), F.min("__key").alias("key"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
    return best.withColumn("rank", place).where(F.col("rank") <= most).select("query_id", "rank", "neighbour", "edge.*")


def children(nodes: DataFrame, parents: DataFrame, limit: int = 25) -> DataFrame:
    """Children of each node in ``parents`` (node_id), in order of (position, node_id)."""
    own = nodes.join(parents.select(F.col("node_id").alias("parent_id")), "parent_id")
    order = F.row_number().over(Window.partitionBy("parent_id").orderBy("position", "node_id"))
    return own.withColumn("place", order).where(F.col("place") <= limit)


def siblings(nodes: DataFrame, of: DataFrame, limit: int = 25) -> DataFrame:
    """Other children of the same parent. of: node_id."""
    own = of.join(nodes, "node_id").select(F.col("node_id").alias("of_id"), "parent_id")
    first = F.row_number().over(Window.partitionBy("parent_id").orderBy("position", "node_id"))
    few = nodes.withColumn("place", first).where(F.col("place") <= limit + 1)  # one of them may be the node itself
    order = F.row_number().over(Window.partitionBy("of_id").orderBy("position", "node_id"))
    return few.join(own, "parent_id").where("node_id <> of_id").withColumn("place", order).where(F.col("place") <= limit)


def parents(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The parent of each node, if it is in the same document."""
    own = of.join(nodes, "node_id").select(F.col("node_id").alias("of_id"), "parent_id", "document_id")
    return own.join(nodes.select(F.col("node_id").alias("parent_id"), "document_id", "name"), ["parent_id", "document_id"])


def schema_evidence(chunks: DataFrame, infer_safety: F.Column, infer_type: F.Column, table: F.Column, column: F.Column) -> DataFrame:
    """table, column, data_type, safety from chunks (chunk_index orders them); the last definition of a column wins."""
    named = chunks.withColumns({"table": table, "column": column, "data_type": infer_type, "safety": infer_safety}).where("table is not null and column is not null")
    last = F.struct("data_type", "safety")
    return named.groupBy("table", "column").agg(F.max_by(last, "chunk_index").alias("l")).select("table", "column", "l.data_type", "l.safety")


def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: hit, recall, reciprocal rank and nDCG at k. results: query_id, chunk_id, rank; relevant: query_id, chunk_id."""
    marked = results.where(F.col("rank") <= k).join(relevant.withColumn("good", F.lit(1)), ["query_id", "chunk_id"], "left").na.fill(0, ["good"])
    gain = F.col("good") / F.log2(F.col("rank") + 1)
    found = marked.groupBy("query_id").agg(F.max("good").alias("hit"), F.sum("good").alias("got"), F.coalesce(F.max(F.col("good") / F.col("rank")), F.lit(0.0)).alias("reciprocal_rank"), F.sum(gain).alias("dcg"))
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return wanted.join(found, "query_id", "left").na.fill(0).select("query_id", "hit", (F.col("got") / F.col("wanted")).alias("recall"), "reciprocal_rank", (F.col("dcg") / ideal).alias("ndcg"))


def find_documents(docs: DataFrame, name: str) -> DataFrame:
    """Documents of a name: the file itself, a file at the end of a path, or a title that starts with it. _ matches any sign."""
    key = name.upper().removesuffix(".HTML").replace(" ", "_")
    path = F.upper("source_path")
    return docs.where((path == f"{key}.HTML") | path.like(f"%/{key}.HTML") | F.upper("title").like(f"{key} - %"))


def named_section(chunks: DataFrame, docs: DataFrame, name: str, section: str, limit: int = 10) -> DataFrame:
    """Chunks of a document's section, in page order."""
    own = chunks.join(find_documents(docs, name).select("doc_id"), "doc_id", "left_semi")
    return own.where(F.lower("heading_path").contains(section.lower())).orderBy("chunk_index", "chunk_id").limit(limit)


def of_category(hits: DataFrame, chunks: DataFrame, category: str, k: int) -> DataFrame:
    """Ranked hits of one category only, ranked anew; ask for three times as many hits as needed."""
    own = hits.join(chunks.where(F.col("category") == category).select("chunk_id"), "chunk_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return own.withColumn("rank", place).where(F.col("rank") <= k)


def search(questions: DataFrame, chunks: DataFrame, posted: DataFrame, k: int, *, vectors: DataFrame | None = None, vector_queries: DataFrame | None = None, relationships: DataFrame | None = None, vocab: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame | None]:
    """Contexts for questions (query_id, question): ranked chunks, and neighbours of their documents if keys are given.

    Lexical: selected tokens, weighted scores, named documents first, a pool four times k made diverse. With vectors,
    both arms give twice k and are fused. k is held between 1 and 25. ``vocab`` is the index's vocabulary if it is at
    hand; ``keep`` may store the selected tokens and the hits.
    """
    k = max(1, min(k, MOST_RESULTS))
    depth = k * HYBRID_DEPTH if vectors is not None else k
    asked = asked_tokens(questions)
    vocab = vocabulary(posted) if vocab is None else vocab
    kept = keep(select_tokens(asked, token_volumes(asked, posted, vocab)).select("query_id", "token", "exact"))
    hints = questions.select("query_id", document_hint(F.col("question")).alias("hint"))
    scored = with_hint(bm25(token_hits(posted, kept, vocab), chunk_sizes(posted)), chunks, hints)
    pool = ranked(scored, depth * POOL, F.col("document_rank").asc(), F.col("score").asc())
    lexical = diverse(pool, depth, exempt=F.upper("source_path") == F.col("hint"))
    best = lexical if vectors is None else fuse(lexical, dense_top(vectors, vector_queries, depth), k=k)
    # a stored table has a known size, so that Catalyst needn't shuffle the texts for a few hits
    found = hydrate(keep(best.select("query_id", "chunk_id", "rank")), chunks)
    if relationships is None:
        return found, None
    seeds = found.groupBy("query_id", "doc_id").agg(F.min("rank").alias("seed_rank"))
    return found, expand_one_hop(seeds.join(questions, "query_id"), relationships, F.col("question"))


def column_summary(evidence: DataFrame) -> DataFrame:
    """Per table: its safe and its identifier columns, each with its type in parentheses, in order of name."""
    named = evidence.withColumn("shown", F.when(F.col("data_type").isNull(), F.col("column")).otherwise(F.concat("column", F.lit(" ("), "data_type", F.lit(")"))))

    def listed(safety: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("safety") == safety, F.col("shown")))), ", ")

    return named.groupBy("table").agg(listed("safe_aggregate").alias("aggregate_safe"), listed("identifier").alias("identifiers"))
