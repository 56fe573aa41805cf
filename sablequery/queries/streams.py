"""Streaming extensions over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.rollup import run_available, windowed_counts
from .registry import query, shared_dir, table


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as a stream over the events file, run until it is read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    found = run_available(spark, windowed_counts(stream), shared_dir(spark))
    return found.withColumn("start", found["start"].cast("timestamp_ntz"))
