"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. toxicity: documents scored 0.5 or more go;
2. near-duplicates: one document of each SimHash component stays;
3. decontamination: documents with a window of a benchmark item go;
4. mixing: sources are repeated toward tempered weights, every document at least once;
5. sharding: every record gets its virtual slot, shard and place.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.

Defined cases: rows of a null doc_id pass the first stage by their score, are duplicates only of rows alike, and are mixed
and sharded like others; null and blank texts score 0, are near duplicates of each other (one stays), hold no benchmark
window and count 0 tokens; of rows repeated whole one stays; texts are taken whole at any length; without labels of both
classes no document is toxic, without benchmark items none is contaminated; no documents give no rows; further columns
are kept, but sharding replaces size, vslot, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sablequery.llm import mixing, simhash, toxicity_mil, virtual_slots, winnowing
from sablequery.llm.common import fresh_path, read_table
from sablequery.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_mil.toxicity_stage(ship_package(spark), docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.dedup_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return winnowing.decontamination_stage(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_stage(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return virtual_slots.shard_stage(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: Learned scores and XXH64 fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
