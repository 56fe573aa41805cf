"""Corpus queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from .registry import query, table


def as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("category"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_documents(table(spark, sf_dir, "pages").select(F.concat("page_id", F.lit(".html")).alias("source_path"), F.sha2("html", 256).alias("source_hash"), "html"))


@query("""SELECT count(*) AS chunks, CAST(quantile_disc(length(text), 0.5) AS INTEGER) AS p50, CAST(quantile_disc(length(text), 0.9) AS INTEGER) AS p90, CAST(quantile_disc(length(text), 0.95) AS INTEGER) AS p95, CAST(quantile_disc(length(text), 0.99) AS INTEGER) AS p99,
 CAST(max(length(text)) AS INTEGER) AS longest, count(*) FILTER (length(text) = 0) AS empty, count(*) FILTER (length(text) < 200) AS near_empty, count(*) FILTER (length(text) > 4800) AS over_limit, count(*) - count(DISTINCT text) AS repeated FROM documents""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.corpus_audit(as_chunks(spark, sf_dir))


@query("SELECT lang AS category, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def corpus_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_category(as_chunks(spark, sf_dir))


@query("SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated_texts(as_chunks(spark, sf_dir))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(r"""SELECT p_partkey, CASE WHEN x = '' THEN 'UNNAMED' ELSE x END AS slug FROM (SELECT p_partkey, upper(regexp_replace(regexp_replace(p_type || ' #' || p_brand || '!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS x FROM part)""")
def identifier_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("p_type", F.lit(" #"), "p_brand", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier_slug(named).alias("slug"))


@query()
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; tests compare it with a brute-force split."""
    pieces = as_chunks(spark, sf_dir).select("doc_id", F.posexplode(D.text_pieces("text")).alias("part", "text"))
    return pieces.select("doc_id", "part", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query()
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("source_path", "title", F.size("chunks").alias("chunks"), F.size("facts").alias("facts"))


@query()
def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunk_table(pages(spark, sf_dir)).select("source_path", "chunk_index", "chunk_id", "category", "heading_path", "text_hash", "token_count")


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.node_table(D.chunk_table(pages(spark, sf_dir)))


@query()
def html_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.corpus_audit(D.chunk_table(pages(spark, sf_dir)))
