"""What a conversation remembers: the last turns of its thread, all forgotten once the thread has been silent for a while.

A turn keeps its thread alive for TTL seconds; a thread silent for that long or longer starts anew. So threads fall into
sessions by the gaps between their turns, and a turn sees the last turns of its own session. The streaming form with kept
state is ``streaming.memory``.

turns: thread_id, ts (timestamp), seq (order among turns of one time), turn. A null thread is a thread; turns without a
time come first and belong to no silence. Extra columns are kept by :func:`remembered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
TTL_SECONDS, MOST_TURNS = 1800.0, 2


def _micros(seconds: float) -> int:
    if seconds <= 0:
        raise ValueError("a memory lasts for a positive time")
    return round(seconds * 1e6)


def with_sessions(turns: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """Adds session, from 1 in each thread."""
    order = Window.partitionBy("thread_id").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    starts = F.when(F.row_number().over(order) == 1, 1).when(gap >= _micros(ttl), 1).otherwise(0)
    return turns.withColumn("session", starts).withColumn("session", F.sum("session").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def remembered(turns: DataFrame, ttl: float = TTL_SECONDS, most: int = MOST_TURNS) -> DataFrame:
    """Adds held: the turns, at most ``most``, that the thread remembers as each turn comes, oldest first.

    Both windows use one shuffle by thread.
    """
    if most < 1:
        raise ValueError("a memory holds one turn or more")
    before = Window.partitionBy("thread_id", "session").orderBy("ts", "seq").rowsBetween(-most, -1)
    return with_sessions(turns, ttl).withColumn("held", F.collect_list("turn").over(before)).drop("session")


def memory_at(turns: DataFrame, now: F.Column, ttl: float = TTL_SECONDS, most: int = MOST_TURNS) -> DataFrame:
    """thread_id, held of every thread that remembers anything at the moment ``now``; later turns don't count."""
    latest = Window.partitionBy("thread_id").orderBy(F.desc("session"), F.desc("ts"), F.desc("seq"))
    placed = with_sessions(turns.where(F.col("ts") <= now), ttl).withColumn("place", F.row_number().over(latest))
    few = placed.where(F.col("place") <= most).groupBy("thread_id").agg(F.max("ts").alias("last"), F.max("session").alias("session"), F.collect_list(F.struct((-F.col("place")).alias("place"), "session", "turn")).alias("held"))
    alive = few.where(F.unix_micros(now) - F.unix_micros("last") < _micros(ttl))
    own = F.filter(F.array_sort("held"), lambda h: h["session"] == F.col("session"))
    return alive.select("thread_id", F.transform(own, lambda h: h["turn"]).alias("held"))
