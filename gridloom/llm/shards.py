"""Sharding by fixed virtual slots.

Records hash into a few thousand virtual slots that never change. Bytes are summed by slot (a partial aggregate whose result
has at most that many rows), and a versioned slot-to-shard map says where each slot lives. A rebalance edits the map: it
writes a new version that moves only as many slots as it must. Maps are kept by name, so a later run finds the map of the table it
shards and edits it where sizes have changed. Finding a record's shard is one hash and one array lookup.

A null doc_id or text hashes like any other value; a record's slot also depends on its text, so that many rows without an id
spread out. Rows that are equal in doc_id and text share a slot. An empty table gets a map and no rows. Extra columns pass; those
named as the columns it adds (size, text_crc32, virtual_slot, shard, first_row, slot) are replaced.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.workspace import shared_dir

from .common import Stage, read

#: Virtual slots; fixed for the life of a store.
SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, crc), F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32 and virtual_slot."""
    return docs.withColumns({"size": size_of(F.col("text")), "text_crc32": crc_of(F.col("text"))}).withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_totals(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by virtual slot: at most as many entries as there are slots, however large the table."""
    return {r[0]: (r[1], r[2]) for r in slotted.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def first_map(totals: dict[int, tuple[int, int]], slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """The shard of each slot: largest slots first, each to the shard that has the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-totals.get(s, (0, 0))[0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + totals.get(slot, (0, 0))[0], shard))
    return out


def rebalance(current: list[int], totals: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> list[int]:
    """An edited copy of the map for that many shards: slots leave the fullest shard for the emptiest while that evens them out and the spread exceeds slack times the mean."""
    out, of = list(current), [[] for _ in range(max(shards, 1 + max(current, default=0)))]
    for slot, shard in enumerate(out):
        of[shard].append(slot)
    weight = lambda s: totals.get(s, (0, 0))[0]
    load = [sum(map(weight, x)) for x in of]
    for gone in range(shards, len(of)):  # shards that are taken away
        for slot in sorted(of[gone], key=weight, reverse=True):
            to = min(range(shards), key=load.__getitem__)
            out[slot], load[to] = to, load[to] + weight(slot)
            of[to].append(slot)
    mean = sum(load[:shards]) / shards
    while True:
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [s for s in of[high] if 0 < weight(s) < gap]
        if gap <= slack * mean or not fits:
            return out
        slot = min(fits, key=lambda s: (abs(weight(s) - gap / 2), s))
        of[high].remove(slot)
        of[low].append(slot)
        out[slot] = low
        load[high] -= weight(slot)
        load[low] += weight(slot)


class MapStore:
    """The versions of a named slot-to-shard map, in the shared folder: a Parquet table with a folder for each version, which is
    there once its success mark is. Versions are only ever added, and of two writers of the same version one fails."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/slot-maps/{name}"

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = (x.getPath() for x in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        return sorted(int(p.getName().removeprefix("version=")) for p in done)

    def read(self, version: int) -> list[int]:
        """The shard of each slot."""
        return [r["shard"] for r in self.spark.read.schema("virtual_slot int, shard int, slot_bytes long").parquet(f"{self.base}/version={version}").orderBy("virtual_slot").collect()]

    def append(self, version: int, placed: list[int], totals: dict[int, tuple[int, int]]) -> None:
        rows = [(slot, shard, totals.get(slot, (0, 0))[0]) for slot, shard in enumerate(placed)]
        self.spark.createDataFrame(rows, "virtual_slot int, shard int, slot_bytes long").coalesce(1).write.parquet(f"{self.base}/version={version}")

    def current(self, totals: dict[int, tuple[int, int]], slots: int = SLOTS, shards: int = SHARDS) -> tuple[int, list[int]]:
        """The latest version, edited (as a new one) where these totals or another number of shards ask for it; the first if there is none."""
        known = self.versions()
        if not known:
            placed = first_map(totals, slots, shards)
            self.append(1, placed, totals)
            return 1, placed
        before = self.read(known[-1])
        if len(before) != slots:
            raise ValueError(f"the map has {len(before)} slots, not {slots}; their number is fixed for the life of a store")
        placed = rebalance(before, totals, shards)
        if placed == before:
            return known[-1], before
        self.append(known[-1] + 1, placed, totals)
        return known[-1] + 1, placed


def place(slotted: DataFrame, placed: list[int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """slotted rows with their shard and first_row, which counts the rows of the shard's earlier slots. The map has one row a slot (thousands), so it is broadcast."""
    rows, seen = [], {}
    for slot, shard in enumerate(placed):
        rows.append((slot, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + totals.get(slot, (0, 0))[1]
    where = slotted.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, first_row long")
    return slotted.drop("shard", "first_row").join(F.broadcast(where), "virtual_slot")


def positions(placed: DataFrame) -> DataFrame:
    """placed rows with slot, the row's gapless place in its shard: its rank in the virtual slot after the rows of the shard's earlier slots. No task ranks more than one virtual slot."""
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("slot", (F.col("first_row") + rank - 1).cast("long")).drop("first_row")


def shard(docs: DataFrame, store: MapStore, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32, virtual_slot, shard and first_row, by the store's current map."""
    slotted = with_slots(docs, slots)
    totals = slot_totals(slotted.select("virtual_slot", "size"))
    return place(slotted, store.current(totals, slots, shards)[1], totals)


def op1_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Stage(spark, "op1").put(with_slots(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    totals = slot_totals(docs)
    _, placed = MapStore(spark, f"documents-{zlib.crc32(sf_dir.encode())}").current(totals)
    out = positions(place(docs, placed, totals))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
