"""Sharding through fixed virtual slots.

Every record is hashed into one of a fixed number of slots (thousands, whatever the number of shards or records).
Bytes and rows are aggregated per slot, and a small versioned table, kept as one folder a version, maps slots to shards.
Version 1 deals the slots in turn, before any record is known; rebalancing to measured bytes or adding a shard writes a
further version: records never change their slot, so only the records of moved slots move.

The slot is a hash of ``doc_id``, ``text`` and the number of the copy among rows alike in both (0, 1, ...), and of nothing
else: it is the same in a table of any size and partitioning, and neither one doc_id nor one text can fill a slot. Copies are
numbered within blocks of at most 65,536 rows of the input, moved up by the copies of earlier blocks. Records get a row
number and are written once before anything is counted, so a task that runs again finds the same rows. Places are counted
within parts of a slot, whose sizes are known, so no task orders more than a part. All of it is DataFrame and SQL
functions. What is gathered at one place is one row per slot or part, a constant number.

Defined cases: a null ``text`` counts 0 bytes; a null ``doc_id`` hashes as the empty text; repeated rows count and are placed
each, and may change places with each other; a document whose text changes is another record; no rows give no rows; a
single record larger than a shard's share stays whole; long texts are only measured and hashed; of incoming columns,
the stage replaces size, vslot, shard and slot and keeps all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, stored

SLOTS = 4096
PARTS = 64
ROW_OVERHEAD = 8
BLOCK_BITS = 16


@dataclass(frozen=True)
class SlotMap:
    """A folder with a folder per version; rows: vslot int, shard int, slot_bytes long, slot_rows long, shards int."""

    path: str
    version: int
    table: DataFrame
    shards: int

    @staticmethod
    def save(table: DataFrame, path: str, version: int, shards: int) -> SlotMap:
        table.withColumn("shards", F.lit(shards)).write.parquet(f"{path}/version={version}")
        return SlotMap.load(table.sparkSession, path, version)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """That version, or the latest."""
        if version is None:
            version = spark.read.parquet(path).agg(F.max("version")).first()[0]
        table = spark.read.parquet(f"{path}/version={version}")
        return SlotMap(path, version, table.drop("shards"), table.agg(F.max("shards")).first()[0])

    def current(self) -> DataFrame:
        return self.table


def virtual_slot(hashed: F.Column, slots: int = SLOTS) -> F.Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def _id(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def record_size(text: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def every_slot(seen: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, slot_bytes, slot_rows of all slots, those without records included."""
    every = seen.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(seen, "vslot", "left").na.fill(0)


def _packed(stats: DataFrame) -> DataFrame:
    """One row holding all slots, largest first. The array's length is at most the fixed number of slots."""
    entry = F.struct((-F.col("slot_bytes")).alias("neg"), F.col("vslot"), F.col("slot_rows"))
    return stats.agg(F.array_sort(F.collect_list(entry)).alias("slots"))


def plan_slots(stats: DataFrame, shards: int, loads: dict[int, int] | None = None) -> DataFrame:
    """Largest slot first, each to the shard with the fewest bytes so far; ``loads`` are bytes that shards hold already."""
    filled_so_far = F.array_sort(F.array(*[F.struct(F.lit((loads or {}).get(k, 0)).cast("long").alias("load"), F.lit(k).alias("shard")) for k in range(shards)]))
    placed = F.array().cast("array<struct<vslot:int,shard:int,slot_bytes:bigint,slot_rows:bigint>>")

    def step(state: F.Column, slot: F.Column) -> F.Column:
        low = F.element_at(state["loads"], 1)
        filled = F.struct((low["load"] - slot["neg"]).alias("load"), low["shard"].alias("shard"))
        choice = F.struct(slot["vslot"].alias("vslot"), low["shard"].alias("shard"), (-slot["neg"]).alias("slot_bytes"), slot["slot_rows"].alias("slot_rows"))
        rest = F.slice(state["loads"], 2, max(shards - 1, 1))
        return F.struct(F.array_sort(F.concat(rest, F.array(filled))).alias("loads"), F.concat(state["placed"], F.array(choice)).alias("placed"))

    done = _packed(stats).select(F.aggregate("slots", F.struct(filled_so_far.alias("loads"), placed.alias("placed")), step).alias("state"))
    return done.select(F.explode("state.placed").alias("p")).select("p.vslot", "p.shard", "p.slot_bytes", "p.slot_rows")


def first_map(stats: DataFrame, shards: int, path: str | None = None) -> SlotMap:
    """Version 1 of a map, planned from known sizes, in a folder of its own or under ``path``."""
    table = plan_slots(stats, shards)
    return SlotMap.save(table, path or fresh_path(stats.sparkSession, "slot-map"), 1, shards)


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS, path: str | None = None) -> SlotMap:
    """Version 1 of a map before any record is known: slots are dealt to the shards in turn."""
    dealt = spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot_bytes"), F.lit(0).cast("long").alias("slot_rows"))
    return SlotMap.save(dealt, path or fresh_path(spark, "slot-map"), 1, shards)


def rebalanced_map(old: SlotMap, stats: DataFrame) -> SlotMap:
    """Next version, edited to measured bytes (``stats`` has every slot).

    A shard above the mean gives up slots, smallest first, until it isn't; what is given up goes largest first to the shard
    with the fewest bytes. All other entries stay. The windows run over the fixed number of slots.
    """
    now = old.current().select("vslot", "shard").join(stats.select("vslot", "slot_bytes", "slot_rows"), "vslot")
    mean = F.lit((now.agg(F.sum("slot_bytes")).first()[0] or 0) / old.shards)
    by_size = Window.partitionBy("shard").orderBy("slot_bytes", "vslot")
    before = F.coalesce(F.sum("slot_bytes").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("slot_bytes").over(Window.partitionBy("shard")) - before
    marked = now.withColumn("__left", left).withColumn("__moves", (F.col("__left") > mean) & (F.col("slot_rows") > 0)).drop("__left")
    stays = marked.where("not __moves").drop("__moves")
    loads = {r["shard"]: r["load"] for r in stays.groupBy("shard").agg(F.sum("slot_bytes").alias("load")).collect()}  # one row a shard
    edited = stays.select("vslot", "shard", "slot_bytes", "slot_rows").unionByName(plan_slots(marked.where("__moves"), old.shards, loads))
    return SlotMap.save(edited, old.path, old.version + 1, old.shards)


def grown_map(old: SlotMap, more: int = 1) -> SlotMap:
    """Next version with ``more`` shards added. Slots move into new shards only; all other entries stay.

    Each old shard gives up slots from its smallest on while what it gives stays within its surplus over the new mean;
    the slots given up are dealt over the new shards in turn. The windows run over the fixed number of slots.
    """
    now = old.current()
    mean = now.agg((F.sum("slot_bytes") / (old.shards + more)).alias("mean"))
    by_size = Window.partitionBy("shard").orderBy("slot_bytes", "vslot")
    given = F.sum("slot_bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("slot_bytes").over(Window.partitionBy("shard"))
    marked = now.withColumn("__given", given).withColumn("__total", total)
    moves = F.col("__given") <= F.col("__total") - F.lit(mean.first()["mean"] or 0.0)
    marked = marked.withColumn("__moves", moves & (F.col("slot_rows") > 0))
    turn = F.row_number().over(Window.partitionBy("__moves").orderBy(F.desc("slot_bytes"), "vslot")) - 1
    target = F.when(F.col("__moves"), F.lit(old.shards) + turn % F.lit(more)).otherwise(F.col("shard"))
    edited = marked.select("vslot", target.cast("int").alias("shard"), "slot_bytes", "slot_rows")
    return SlotMap.save(edited, old.path, old.version + 1, old.shards + more)


def numbered(docs: DataFrame, *more: str | F.Column) -> DataFrame:
    """A stored table of row (its number), doc_id, size, key (a hash of id and text) and further columns of ``docs``."""
    key = F.xxhash64(_id(), F.xxhash64("text")).alias("key")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", record_size().alias("size"), key, *more), "slot-records")


def with_slots(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records`` (row, key, ...; stored) with vslot and part, a hash of key and copy."""
    blocked = records.withColumn("block", F.shiftright("row", BLOCK_BITS))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocked.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).select("key", "block", earlier.alias("before")).where("before > 0")
    within = F.row_number().over(Window.partitionBy("key", "block").orderBy("row")) - 1
    copies = blocked.withColumn("copy", within).join(offsets, ["key", "block"], "left")
    hashed = F.xxhash64("key", F.col("copy") + F.coalesce("before", F.lit(0)))
    return copies.withColumns({"vslot": virtual_slot(hashed, slots), "part": F.shiftright(hashed, 40).bitwiseAND(PARTS - 1).cast("int")}).drop("block", "copy", "before")


def part_statistics(records: DataFrame) -> DataFrame:
    """Bytes and rows of every part of a slot that has any."""
    return records.groupBy("vslot", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))


def place(records: DataFrame, parts: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard, and slot: the record's place in its shard, gapless from 0.

    Places are counted within a part (by doc_id, then key and row) and moved up by the rows of the shard's earlier parts.
    Parts have one row each, SLOTS x PARTS at most, and are broadcast.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1))
    entry = parts.join(F.broadcast(slot_map.current().select("vslot", "shard")), "vslot").select("vslot", "part", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "key", "row"))
    joined = records.withColumn("within", within).join(F.broadcast(entry), ["vslot", "part"])
    return joined.withColumn("slot", (F.col("before") + F.col("within") - 1).cast("long")).drop("before", "within", "part")


def placed(records: DataFrame, shards: int, slots: int) -> DataFrame:
    """Records with shard, vslot and slot by version 2 of a map, rebalanced to their bytes."""
    slotted = stored(with_slots(records, slots), "slot-numbers")
    parts = stored(part_statistics(slotted), "slot-parts")
    by_slot = parts.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.sum("rows").alias("slot_rows"))
    return place(slotted, parts, rebalanced_map(even_map(records.sparkSession, shards, slots), every_slot(by_slot, slots)))


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Digest of the placement: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    The map weighs slots by measured bytes, so the law kept is ``bytes``: shard sizes are near equal.
    """
    found = placed(numbered(docs, F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")), shards, slots)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard_stage(spark: SparkSession, docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every record with size, vslot, shard and slot added. Places are found without the texts, which are shuffled once."""
    names = [c for c in docs.columns if c.lower() not in ("size", "vslot", "shard", "slot")]
    whole = numbered(docs, F.struct(*names).alias("record"))
    found = placed(whole.drop("record"), shards, slots).select("row", "size", "vslot", "shard", "slot")
    return whole.select("row", "record").join(found, "row").select("record.*", "size", "vslot", "shard", "slot")
