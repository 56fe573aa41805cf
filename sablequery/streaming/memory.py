"""Conversation memory as keyed state with expiry; :func:`operators.memory.remembered` is the batch form."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import MOST_TURNS, TTL_SECONDS


def remembered_stream(turns: DataFrame, ttl: float = TTL_SECONDS, most: int = MOST_TURNS, late: str = "10 minutes") -> DataFrame:
    """thread_id, seq, turn, held (as JSON) for a stream of thread_id, ts, seq, turn.

    The state of a thread is its last turns and their time, whatever its length. Turns of one micro-batch are put in order;
    a turn that comes in a later batch than a younger one sees what the thread holds then. State goes once the
    watermark has passed the end of its time to live.
    """
    kept = round(ttl * 1e6)

    def remember(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "seq"])
        held, last = [], None
        if state.exists:
            text, last = state.get
            held = json.loads(text)
        seen = []
        for us, turn in zip(rows["us"].tolist(), rows["turn"].tolist(), strict=True):
            if last is not None and us - last >= kept:
                held = []
            seen.append(json.dumps(held))
            held = [*held, turn][-most:]
            last = us if last is None else max(last, us)
        state.update((json.dumps(held), last))
        state.setTimeoutTimestamp(max((last + kept) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"thread_id": rows["thread_id"].tolist(), "seq": rows["seq"].tolist(), "turn": rows["turn"].tolist(), "held": seen})

    timed = turns.select(F.col("thread_id").cast("string").alias("thread_id"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("turn").cast("string").alias("turn")).where("ts is not null")
    grouped = timed.withWatermark("ts", late).groupBy("thread_id")
    return grouped.applyInPandasWithState(remember, "thread_id string, seq long, turn string, held string", "held string, last long", "append", GroupStateTimeout.EventTimeTimeout)
