"""Sharding over fixed virtual slots.

Records are hashed into ``slots`` slots, a number that never changes. Which shard holds a slot is said by a small
versioned map (version, slot, shard). Rebalancing adds up bytes by slot and edits the map: shards above their share
give up slots, shards below take them, and all other slots stay. One more shard is such an edit too. The map is stored by version, each a partition
that is added and never changed; readers take the newest one that has all its slots.

Slots are hashed from doc_id and text, so a group of equal texts is spread over all shards: the law is ``bytes``, and a group
that holds a third of all bytes could not stay together under it. Equal rows share a slot.

Defined results: a null text has no bytes, so size 1. A null doc_id hashes as such. Rows of a
slot are in the order of doc_id, nulls first, then crc32 and size; an empty table gives no rows. A very long text is one record of its size.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_text, cut


@dataclass
class SlotMap:
    """``shard`` has the shard of each slot in the newest version; ``history`` has the older ones."""

    shard: list[int]
    shards: int
    version: int = 1
    history: list[list[int]] = field(default_factory=list)

    @classmethod
    def even(cls, slots: int, shards: int) -> SlotMap:
        return cls([s * shards // slots for s in range(slots)], shards)

    def rebalanced(self, weight: list[int], shards: int | None = None) -> SlotMap:
        """A next version in which the weights of the shards are as near to equal as whole slots allow."""
        n, at = shards or self.shards, list(self.shard)
        load, held = [0] * n, [[] for _ in range(n)]
        for slot, s in enumerate(at):
            load[s] += weight[slot]
            held[s].append(slot)
        share = sum(weight) / n

        def move(slot: int, a: int, b: int) -> None:
            held[a].remove(slot), held[b].append(slot)
            load[a] -= weight[slot]
            load[b] += weight[slot]
            at[slot] = b

        for a in range(n):  # large slots first, as far as they fit in what is too much
            for slot in sorted(held[a], key=lambda x: (-weight[x], x)):
                b = min(range(n), key=lambda x: (load[x], x))
                if 0 < weight[slot] <= load[a] - share and a != b:
                    move(slot, a, b)
        for _ in range(len(weight)):
            a, b = max(range(n), key=lambda x: (load[x], -x)), min(range(n), key=lambda x: (load[x], x))
            gap = load[a] - load[b]
            best = min((x for x in held[a] if 0 < weight[x] < gap), key=lambda x: (abs(weight[x] - gap / 2), x), default=None)
            if best is None:
                break
            move(best, a, b)
        return SlotMap(at, n, self.version + 1, [*self.history, self.shard])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard, shards) of every version, as it is stored."""
        return spark.createDataFrame([(v, slot, s, self.shards) for v, own in enumerate([*self.history, self.shard], 1) for slot, s in enumerate(own)], "version int, slot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add the versions that aren't stored whole yet, each as a partition of its own; what is stored is never touched, so a crash loses no version."""
        try:
            known = _whole(spark, path)
        except AnalysisException:  # nothing there yet
            known = {}
        rows = self.frame(spark).filter(~F.col("version").isin(*known)) if known else self.frame(spark)
        rows.withColumn("slots", F.lit(len(self.shard))).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """The newest version that is whole, and the whole ones before it."""
        own = _whole(spark, path)
        newest = max(own)
        return cls(own[newest][0], own[newest][1], newest, [own[v][0] for v in sorted(own) if v < newest])


def _whole(spark: SparkSession, path: str) -> dict[int, tuple[list[int], int]]:
    """(shard of each slot, shards) by version, of versions of which every slot is stored; slots x versions rows."""
    rows: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in spark.read.parquet(path).collect():
        rows.setdefault(r["version"], {})[r["slot"]] = (r["shard"], r["shards"], r["slots"])
    return {v: ([of[s][0] for s in sorted(of)], of[0][1]) for v, of in rows.items() if 0 in of and len(of) == of[0][2]}


def hashed(docs: DataFrame, slots: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc_text(F.col("text")).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"))


def shard(docs: DataFrame, shards: int = 8, slots: int = 4096, start: SlotMap | None = None, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Each record's shard and its place in it, and the map after rebalancing by bytes, which is stored under ``path`` and read from there.

    Only (slot, bytes, rows) of the fixed number of slots reach the driver. A record's place is that of its slot in
    the shard, from the slots' row counts, plus its place in the slot.
    """
    rows = cut(hashed(docs, slots))
    found = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    weight = [found[s]["size"] if s in found else 0 for s in range(slots)]
    newest = (start or SlotMap.even(slots, shards)).rebalanced(weight, shards)
    if path is not None:
        newest.save(rows.sparkSession, path)
        newest = SlotMap.load(rows.sparkSession, path)
    place, taken = [], [0] * shards
    for slot, s in enumerate(newest.shard):
        place.append((slot, s, taken[s], newest.version))
        taken[s] += found[slot]["n"] if slot in found else 0
    placed = rows.sparkSession.createDataFrame(place, "virtual_slot int, shard int, before long, map_version int")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("slot", F.row_number().over(order))
    out = ranked.join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1 + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
    return out, newest
