"""Sharding by virtual slots: records hash into thousands of slots; a versioned map puts slots on shards."""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlens.llm import common as C

SLOTS = 4096
#: Rows of a slot that are numbered together; larger slots are numbered in parts.
PART_ROWS = 200_000
#: Shards whose bytes are so near, as a share of the mean, need no more edits.
NEAR = 0.002


@dataclass(frozen=True)
class SlotMap:
    """shard_of[v]: the shard of virtual slot v. Editing gives the next version; moved lists its edits (slot, from, to)."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1
    moved: tuple[tuple[int, int, int], ...] = field(default=())

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(tuple(v % shards for v in range(slots)), shards)

    def edited(self, size_of: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the shard with the most bytes to the one with the fewest, few and large ones first.

        Each move is the largest slot that neither empties the one below the mean nor fills the other above it; without such a
        slot, the smallest that brings the two nearer. It ends when no move does, or all are within NEAR of the mean. With more shards
        than before the new ones start empty; with fewer, the slots of those that are gone are dealt out first. Slots without bytes stay.
        """
        shards = shards or self.shards
        new, own = list(self.shard_of), [[] for _ in range(shards)]
        for v, s in enumerate(self.shard_of):
            if s < shards and size_of.get(v, 0):
                own[s].append((size_of[v], v))
        total = [sum(b for b, _ in vs) for vs in own]
        for v in sorted((v for v, s in enumerate(self.shard_of) if s >= shards), key=lambda v: (-size_of.get(v, 0), v)):
            new[v] = s = min(range(shards), key=lambda s: (total[s], len(own[s]), s))
            own[s].append((size_of.get(v, 0), v))
            total[s] += size_of.get(v, 0)
        for vs in own:
            vs.sort()
        mean = sum(total) / shards
        while True:
            high, low = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
            if total[high] - total[low] <= NEAR * mean:
                break
            at = bisect.bisect_right(own[high], (min(total[high] - mean, mean - total[low]), len(new))) - 1
            if at < 0:
                at = 0
                if not own[high] or own[high][0][0] >= total[high] - total[low]:
                    break
            size, v = own[high].pop(at)
            bisect.insort(own[low], (size, v))
            total[high], total[low], new[v] = total[high] - size, total[low] + size, low
        edits = tuple((v, a, b) for v, (a, b) in enumerate(zip(self.shard_of, new, strict=True)) if a != b)
        return SlotMap(tuple(new), shards, self.version + 1, edits)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v, s, self.shards, self.version) for v, s in enumerate(self.shard_of)], "virtual_slot int, shard int, shards int, version int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map's history at `path`."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map at `path`, the last where none is named."""
        kept = spark.read.schema("virtual_slot int, shard int, shards int, version int").parquet(path)
        version = version or kept.agg(F.max("version")).first()[0]
        rows = sorted(kept.filter(F.col("version") == version).select("virtual_slot", "shard", "shards").collect())
        return SlotMap(tuple(r.shard for r in rows), rows[0].shards, version)


def slot_of(slots: int) -> Column:
    """The virtual slot of a row, by its doc_id and text: rows that share one doc_id are dealt out."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def shard(spark: SparkSession, docs: DataFrame, shards: int | None = None, slots: int = SLOTS, store: str | None = None, current: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Every row of `docs` (doc_id, text) with its place, and the slot map used.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: 0), law, shard, slot
    (the row's place in its shard, gapless from 0, by virtual slot), grown_shard (null under this law), virtual_slot, map_version.
    Law `bytes`: the `current` map is edited until sizes are near equal; to rebalance, give SlotMap.load(store), and another
    number of shards to grow or shrink. Without one, version 1 deals slots out evenly (8 shards) and version 2 is its edit. What is
    new is added to the history at `store`. Rows of equal id and text share a slot, and a slot is the least that can move; such rows
    are numbered in any order, as they cannot be told apart. A null doc_id or text counts as a value. An empty table gives an empty result.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), slot_of(slots).alias("virtual_slot"))
    # The row number is written down, so it stays as it is when a task runs again; it deals equal rows out as well.
    light = C.Scratch(spark, "sharding").write(light.withColumn("row", F.monotonically_increasing_id()), "light")
    # At most `slots` rows reach the driver.
    used = {r.virtual_slot: (r.bytes, r.rows) for r in light.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    first = current or SlotMap.even(shards or 8, slots)
    placed = first.edited({v: b for v, (b, _) in used.items()}, shards)
    for m in (first, placed) if current is None else (placed,):
        if store:
            m.store(spark, store)
    parts = {v: 1 + n // PART_ROWS for v, (_, n) in used.items()}
    places = spark.createDataFrame([(v, placed.shard_of[v], placed.version, n) for v, n in sorted(parts.items())], "virtual_slot int, shard int, version int, parts int")
    rows = light.join(F.broadcast(places), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    before = rows.groupBy("virtual_slot", "part", "shard", "version").agg(F.count("*").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = before.withColumn("base", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).select("virtual_slot", "part", "base")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "row")))
    base = F.broadcast(base) if sum(parts.values()) <= 100_000 else base
    out = ranked.join(base, ["virtual_slot", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
    return out, placed


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`; nulls, ties, repeats and empty tables as in shard."""
    store = f"{C.scratch_root(spark)}/slot-map-{uuid.uuid4().hex[:12]}"
    return shard(spark, C.table(spark, sf_dir, "documents"), store=store)[0]
