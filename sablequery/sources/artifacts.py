"""HTML files in, relations and metric reports out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def lenient_text(content: pd.Series) -> pd.Series:
    """UTF-8 with malformed bytes replaced; Spark's own decode raises on them."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """source_path (relative to ``path``), source_hash (SHA-256 of the bytes), html (UTF-8, malformed bytes replaced)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    root = path.rstrip("/").split("/")[-1]
    relative = F.when(F.lit(path.endswith(".html")), name).otherwise(F.substring_index("path", f"/{root}/", -1))
    return files.select(relative.alias("source_path"), F.sha2("content", 256).alias("source_hash"), lenient_text("content").alias("html"))


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder per relation. Readers see a relation once its write is committed."""
    for name, frame in relations.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_relations(spark: SparkSession, folder: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    """The named relations; their stored version must be the one asked for."""
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    if version is not None:
        stored = found["index_metadata"].where("key = 'version'").first()
        if stored is None or stored["value"] != version:
            raise ValueError(f"index version is {stored and stored['value']}, not {version}")
    return found


def relation_faults(relations: dict[str, DataFrame]) -> list[str]:
    """Stored row counts that differ from recounts, chunks of no document, fewer nodes than documents and chunks."""
    stored = {r["key"]: r["value"] for r in relations["index_metadata"].collect()}
    counts = {name: relations[name].count() for name in ("docs", "chunks", "nodes", "section_facts", "table_relationships") if name in relations}
    faults = [f"{name}: {n} rows, {stored[f'{name}_count']} stored" for name, n in counts.items() if stored.get(f"{name}_count", str(n)) != str(n)]
    orphans = relations["chunks"].join(relations["docs"], "doc_id", "left_anti").count()
    faults += [f"chunks: {orphans} of no document"] * bool(orphans)
    if "nodes" in counts and counts["nodes"] < counts["docs"] + counts["chunks"]:
        faults.append("nodes: fewer than documents and chunks")
    return faults


def export_report(summary: DataFrame, folder: str, kind: str) -> None:
    """A roll-up as one JSON or CSV file; doubles rounded to two places, cost per query to four."""
    rounded = summary.select(*[F.round(c, 4 if c == "avg_cost_per_query" else 2).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])
    writer = rounded.coalesce(1).write.mode("overwrite")
    {"json": writer.json, "csv": writer.option("header", True).csv}[kind](folder)


def report_markdown(summary: DataFrame, title: str, most: int = 1000) -> str:
    """A small roll-up as a Markdown table; more than ``most`` rows are an error, since the driver holds them all."""
    rows = [[str(round(v, 2)) if isinstance(v, float) else str(v) for v in r] for r in summary.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: export it instead")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """position, chunk_id, embedding. Every position and chunk stands once, without gaps; the stored model must be the one asked for."""
    frame = spark.read.parquet(path)
    missing = {"position", "chunk_id", "embedding"} - set(frame.columns)
    if missing:
        raise ValueError(f"vector index lacks {sorted(missing)}")
    n = frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("p"), F.count_distinct("chunk_id").alias("c"), F.coalesce(F.max("position") + 1, F.lit(0)).alias("m"), F.count_distinct(F.size("embedding")).alias("d")).first()
    if not n["n"] == n["p"] == n["c"] == n["m"] or n["d"] > 1:
        raise ValueError("vectors and mapping don't match")
    if model is not None and frame.where(F.coalesce("model", F.lit("")) != model).limit(1).count():
        raise ValueError(f"vectors are not of model {model}")
    return frame
