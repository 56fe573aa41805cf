"""Structured Streaming forms of the log roll-ups; an extension, the batch forms are in operators.logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type counts per window of event time; windows close once the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_available(spark: SparkSession, rows: DataFrame, shared: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the result. State and output lie in the shared folder."""
    path = f"{shared}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/out")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out-{number}")
        last[0] = number

    last = [-1]
    query = rows.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{path}/out-{last[0]}")
