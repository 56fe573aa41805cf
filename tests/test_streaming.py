"""Streaming roll-ups equal the batch result; late events are dropped once their window has closed."""

from pyspark.sql import functions as F

from sablequery.streaming.rollup import run_available, windowed_counts


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{small}/events.parquet*")
    got = {(r["start"], r["event_type"]): r["n"] for r in run_available(spark, windowed_counts(stream), f"file://{tmp_path}").collect()}
    wanted = events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count().collect()
    assert got == {(r["start"], r["event_type"]): r["count"] for r in wanted}


def test_append_holds_back_open_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{small}/events.parquet*")
    closed = run_available(spark, windowed_counts(stream, "1 hour", "2 hours"), f"file://{tmp_path}", "append")
    latest = events.agg(F.max("ts")).first()[0]
    assert 0 < closed.count() < events.groupBy(F.date_trunc("hour", "ts"), "event_type").count().count()
    assert closed.agg(F.max("start")).first()[0] < latest


def test_nothing_to_read_gives_no_rows(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert run_available(spark, windowed_counts(stream), f"file://{tmp_path}").count() == 0
