"""Conversation memory against a store with a clock, in batch and as a stream."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sablequery.operators import memory
from sablequery.streaming.memory import remembered_stream
from sablequery.streaming.rollup import run_available

START = datetime.datetime(2024, 3, 1)
SCHEMA = "thread_id string, ts timestamp, seq long, turn string"


def made(n=400):
    rng, clock, rows = random.Random(3), {}, []
    for seq in range(n):
        thread = rng.choice(["a", "a", "a", "b", "c", None])
        clock[thread] = clock.get(thread, 0) + rng.choice([0, 1, 60, 1799, 1800, 1801, 9000])
        rows.append((thread, START + datetime.timedelta(seconds=clock[thread]), seq, f"t{seq}"))
    return rows


def loop(rows):
    """What a store returns as each turn comes, by seq, and (turns, last time) of each thread at the end."""
    seen, store = {}, {}
    for thread, ts, seq, turn in sorted(rows, key=lambda r: (r[1], r[2])):
        held, last = store.get(thread, ([], None))
        if last is not None and (ts - last).total_seconds() >= 1800:
            held = []
        seen[seq] = held
        store[thread] = ([*held, turn][-2:], ts)
    return seen, store


def test_memory_matches_a_store(spark):
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seen, store = loop(rows)
    assert {r["seq"]: r["held"] for r in memory.remembered(frame).collect()} == seen
    assert any(len(h) == 2 for h in seen.values()) and not all(seen.values())
    for after in (0, 1799, 1800):
        for moment in {last for _, last in store.values()}:
            now = moment + datetime.timedelta(seconds=after)
            _, then = loop([r for r in rows if r[1] <= now])
            wanted = {t: h for t, (h, last) in then.items() if (now - last).total_seconds() < 1800}
            assert {r["thread_id"]: r["held"] for r in memory.memory_at(frame, F.lit(now)).collect()} == wanted
    assert memory.remembered(frame.where("false")).count() == 0
    for bad in ({"ttl": 0}, {"most": 0}):
        with pytest.raises(ValueError):
            memory.remembered(frame, **bad)


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_keeps_state_between_batches(spark, tmp_path, batches):
    rows = sorted((r for r in made(150) if r[0] is not None), key=lambda r: (r[1], r[2]))
    cut = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["seq"]: json.loads(r["held"]) for r in run_available(spark, remembered_stream(stream), f"file://{tmp_path}", "append").collect()}
    assert got == loop(rows)[0]
