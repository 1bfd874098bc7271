"""Operator 9 [native]: sharding by fixed virtual slots and a versioned slot map.

Records are hashed by id into ``N_SLOTS`` virtual slots, bytes and rows are added up per
slot, and a map from slot to shard is edited until the shards weigh about the same. The
map is the only state, and it is stored: version 0 deals the slots out in turn, every
rebalancing edits the latest stored version, moves few slots and leaves the rest where
they are, and appends the next one. Rows are placed by joining the stored version, which
has ``n_slots`` rows. Law: ``bytes``.

Rows with the same id, size and checksum are one row with a number of copies until the
end. Where the rows of one home slot alone weigh more than a quarter of a shard, they are
salted over the slots that follow: by the checksum of the text, and copies in turn, so that
a hot id is split and the same rows are dealt alike in whatever files they lie.

The texts are read once and only ids, sizes and checksums are shuffled. What the driver
holds is the table of slots, whose length is the parameter ``n_slots``.

Null text has no bytes and checksum 0; a null id hashes like any other value. Repeated
rows are separate rows with places of their own; rows that only differ in other columns are
interchangeable. An empty table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

import heapq
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.llm import common

N_SLOTS = 4096
N_SHARDS = 40
ROW_BYTES = 16
#: Copies of a row that are numbered at once.
COPIES_AT_ONCE = 1 << 14


def first_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalanced(current: list[int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    """The next version: slots move, heaviest first, from the shard that is above the mean
    to the lightest one as long as that brings the two closer; then all that still gains."""
    shard_of = list(current)
    load = [0] * n_shards
    for slot, shard in enumerate(shard_of):
        if shard >= n_shards:  # a shard that goes: its slots are dealt out first
            shard_of[slot] = -1
        else:
            load[shard] += slot_bytes.get(slot, 0)
    mean = sum(slot_bytes.values()) / n_shards
    loose = [slot for slot, shard in enumerate(shard_of) if shard < 0]
    for slot in sorted(range(len(shard_of)), key=lambda s: (slot_bytes.get(s, 0), s)):
        shard = shard_of[slot]
        if shard >= 0 and load[shard] > mean and slot_bytes.get(slot, 0):
            load[shard] -= slot_bytes[slot]
            shard_of[slot] = -1
            loose.append(slot)
    heap = [(load[shard], shard) for shard in range(n_shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-slot_bytes.get(s, 0), s)):
        weight, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (weight + slot_bytes.get(slot, 0), shard))
    return shard_of


def _slot_table(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """slot and a column of numbers for each list, by slot: one literal each, whatever their length."""
    numbers = [F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>").alias(name) for name, values in columns.items()]
    rows = F.posexplode(F.arrays_zip(*numbers)).alias("slot", "row")
    return spark.range(1).select(rows).select("slot", *[F.col(f"row.{name}").alias(name) for name in columns])


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Append a version; versions are never changed."""
    rows = _slot_table(spark, shard=shard_of).select("slot", F.col("shard").cast("int").alias("shard"))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """slot and shard of a stored version."""
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions, in order; none where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version as a list by slot, by default the latest."""
    version = versions(spark, path)[-1] if version is None else version
    return [r.shard for r in sorted(stored_map(spark, path, version).collect(), key=lambda r: r.slot)]  # n_slots rows


def counted_rows(documents: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, home slot and number of copies of the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = documents.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    home = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(n_slots)).cast("int")
    return ids.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("home", home)


def _salted(rows: DataFrame, n_slots: int, n_shards: int) -> DataFrame:
    """``rows`` with virtual_slot, and with the copies that each slot gets."""
    homes = rows.groupBy("home").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n")).collect()  # at most n_slots rows
    share = max(1, sum(r["bytes"] for r in homes) // (4 * n_shards))
    #: How many slots a home is spread over: 1 but where it weighs more than a quarter of a shard.
    spread = [1] * n_slots
    for r in homes:
        spread[r["home"]] = min(n_slots, max(1, -(-r["bytes"] // share))) if r["n"] > 1 else 1
    if max(spread) == 1:
        return rows.withColumn("virtual_slot", F.col("home")).drop("home")
    wide = rows.join(F.broadcast(_slot_table(rows.sparkSession, spread=spread).withColumnRenamed("slot", "home")), "home")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("copies", "spread") - 1)).alias("turn")
    dealt = wide.select("doc_id", "size", "text_crc32", "home", "spread", "copies", turn)
    own = F.expr("copies div spread") + F.when(F.col("turn") < F.col("copies") % F.col("spread"), 1).otherwise(0)
    slot = F.pmod(F.col("home") + F.pmod(F.xxhash64("text_crc32") + F.col("turn"), "spread"), F.lit(n_slots)).cast("int")
    return common.cut(dealt.select("doc_id", "size", "text_crc32", own.cast("long").alias("copies"), slot.alias("virtual_slot")))


def shard(documents: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with size, text_crc32, virtual_slot, shard and slot (its place in the shard).

    ``map_path`` is the folder of the versioned map, by default a new one in the shared
    folder. The latest version there is edited, and the edited one is stored and joined.
    """
    spark = documents.sparkSession
    map_path = map_path or f"{common.shared_folder(spark)}/slot-map-{uuid4().hex}"
    if not versions(spark, map_path):
        store_map(spark, map_path, 0, first_map(n_slots, n_shards))
    latest = versions(spark, map_path)[-1]
    rows = _salted(common.cut(counted_rows(documents, n_slots)), n_slots, n_shards)
    sums = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    slots = {r["virtual_slot"]: r for r in sums.collect()}  # at most n_slots rows
    shard_of = rebalanced(load_map(spark, map_path, latest), {k: r["bytes"] for k, r in slots.items()}, n_shards)
    store_map(spark, map_path, latest + 1, shard_of)
    # Places: slots of a shard follow each other, rows are numbered within their slot.
    before, used = [0] * n_slots, [0] * n_shards
    for slot in range(n_slots):
        before[slot] = used[shard_of[slot]]
        used[shard_of[slot]] += slots[slot]["n"] if slot in slots else 0
    places = stored_map(spark, map_path, latest + 1).join(_slot_table(spark, before=before), "slot").withColumnRenamed("slot", "virtual_slot")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("until", F.sum("copies").over(within)).join(F.broadcast(places), "virtual_slot")
    first = F.col("before") + F.col("until") - F.col("copies")
    placed = placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "copies", first.alias("first"))
    # Copies are numbered in blocks, so that no array is longer than a block.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("block")
    placed = placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "copies", "first", blocks)
    last = F.least(F.col("copies"), F.col("block") + COPIES_AT_ONCE) - 1
    slot = F.explode(F.sequence(F.col("first") + F.col("block"), F.col("first") + last)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot)


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of about equal bytes."""
    placed = shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
