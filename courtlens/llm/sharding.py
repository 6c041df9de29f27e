"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots, whose number never changes. A table of slot and
shard, stored by version, says where a slot lives. Spark sums bytes and rows per slot, so what the
driver sees is one row per slot whatever the input. The first version deals slots, heavy ones
first, to the lightest shard; later versions are edits of the one before: ``grown`` moves slots only
into one more shard, ``evened`` moves slots from the heaviest shards to the lightest. A record's
hash is never taken again.

A slot far beyond the mean can only come from repeated records, of a null id for instance: their
copies are hashed with a number of their own and so spread over all slots.
"""

from __future__ import annotations

import heapq
import math
from typing import Iterable, NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from courtlens.llm.common import stage
from courtlens.sources.tables import shared_folder

SLOTS = 8192
SHARDS = 40
#: Bytes that a record counts besides its text.
OVERHEAD = 16
#: A slot of more rows than ``CROWD`` and more bytes than ``HEAVY`` times the mean holds copies.
CROWD, HEAVY = 1000, 8
#: Records numbered together in one window, on average.
PER_WINDOW = 100_000
LAW = "bytes"


class Slot(NamedTuple):
    slot: int
    bytes: int
    rows: int


# ---- versions of the map -------------------------------------------------------------------------


def first_map(loads: Iterable[Slot], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Shard of every slot: heavy slots first, each to the shard of fewest bytes (ties: fewest slots)."""
    found = {s.slot: s.bytes for s in loads}
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-found.get(s, 0), s)):
        weight, held, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (weight + found.get(slot, 0), held + 1, shard))
    return placed


def _weights(placed: dict[int, int], found: dict[int, int]) -> dict[int, int]:
    weights = dict.fromkeys(placed.values(), 0)
    for slot, shard in placed.items():
        weights[shard] += found.get(slot, 0)
    return weights


def grown(placed: dict[int, int], loads: Iterable[Slot]) -> dict[int, int]:
    """The map with one more shard. Slots move only into it, heavy ones first, as long as neither
    it rises above the new mean nor the shard that gives falls below it."""
    found = {s.slot: s.bytes for s in loads}
    weights = _weights(placed, found)
    new = max(weights, default=-1) + 1
    mean = sum(weights.values()) / (len(weights) + 1)
    out, held = dict(placed), 0
    for slot in sorted(placed, key=lambda s: (-found.get(s, 0), s)):
        size = found.get(slot, 0)
        if size and held + size <= mean and weights[placed[slot]] - size >= mean:
            out[slot] = new
            weights[placed[slot]] -= size
            held += size
    return out


def evened(placed: dict[int, int], loads: Iterable[Slot], slack: float = 0.01) -> dict[int, int]:
    """The map after moves from the heaviest shard to the lightest, until they differ by ``slack``
    of the mean at most or no move brings them closer. Every move brings two shards closer."""
    found = {s.slot: s.bytes for s in loads}
    weights = _weights(placed, found)
    mean = sum(weights.values()) / max(1, len(weights))
    out = dict(placed)
    held: dict[int, list[int]] = {shard: [] for shard in weights}
    for slot, shard in placed.items():
        if found.get(slot, 0):
            held[shard].append(slot)
    while weights:
        heavy = max(weights, key=lambda s: (weights[s], -s))
        light = min(weights, key=lambda s: (weights[s], s))
        gap = weights[heavy] - weights[light]
        fitting = [s for s in held[heavy] if found[s] < gap]
        if gap <= slack * mean or not fitting:
            return out
        slot = min(fitting, key=lambda s: (abs(gap - 2 * found[s]), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        out[slot] = light
        weights[heavy] -= found[slot]
        weights[light] += found[slot]
    return out


class SlotMaps:
    """The versions of one map, a folder each below ``place``; a version is written once."""

    def __init__(self, spark: SparkSession, place: str | None = None):
        self.spark = spark
        self.place = place or shared_folder(spark, "slot_map")

    def write(self, version: int, placed: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(placed.items()), "virtual_slot int, shard int")
        rows.coalesce(1).write.parquet(f"{self.place}/version={version}")

    def read(self, version: int) -> DataFrame:
        """(virtual_slot, shard), one row per slot."""
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.place}/version={version}")


# ---- records -------------------------------------------------------------------------------------


def slotted(docs: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text",
            crowd: int = CROWD) -> tuple[DataFrame, list[Slot]]:
    """(doc_id, size, text_crc32, virtual_slot) per row, staged, and the loads of the slots."""
    raw = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    inner = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"))
    place = lambda *more: F.pmod(F.xxhash64("doc_id", "size", "text_crc32", *more), F.lit(slots)).cast("int")
    rows = stage(inner.withColumn("virtual_slot", place()), "slotted")
    loads = _loads(rows)
    mean = sum(s.bytes for s in loads) / slots
    crowded = [s.slot for s in loads if s.rows > crowd and s.bytes > HEAVY * mean]
    if not crowded:
        return rows, loads
    spread = F.when(F.col("virtual_slot").isin(crowded), place(F.monotonically_increasing_id())).otherwise(F.col("virtual_slot"))
    rows = stage(rows.withColumn("virtual_slot", spread), "slotted")
    return rows, _loads(rows)


def _loads(rows: DataFrame) -> list[Slot]:
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return [Slot(r["virtual_slot"], r["bytes"], r["n"]) for r in sums.collect()]


def placed(rows: DataFrame, slot_map: DataFrame, total: int, slots: int = SLOTS, per_window: int = PER_WINDOW) -> DataFrame:
    """``rows`` with the columns of ``slot_map`` and slot, the row's place in its shard from 0 without gaps.

    Rows are numbered within parts of virtual slots of about ``per_window`` rows; counts of the
    parts give each part its first place, so no shard is one task.
    """
    deals = max(1, math.ceil(total / (slots * per_window)))
    own = F.pmod(F.xxhash64("text_crc32", "doc_id", F.monotonically_increasing_id()), F.lit(deals)) if deals > 1 else F.lit(0)
    dealt = rows.withColumn("deal", own.cast("int"))
    dealt = stage(dealt, "dealt") if deals > 1 else dealt
    named = dealt.join(F.broadcast(slot_map), "virtual_slot")  # one narrow row per slot, a fixed number
    sizes = named.groupBy("shard", "virtual_slot", "deal").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "deal")) - F.col("n")
    firsts = sizes.select("virtual_slot", "deal", before.alias("first"))
    order = Window.partitionBy("virtual_slot", "deal").orderBy("doc_id", "text_crc32", "size")
    numbered = named.withColumn("number", F.row_number().over(order) - 1).join(firsts, ["virtual_slot", "deal"])
    more = [c for c in slot_map.columns if c != "virtual_slot"]
    return numbered.select(*rows.columns, *more, (F.col("number") + F.col("first")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text",
          maps: SlotMaps | None = None, crowd: int = CROWD, per_window: int = PER_WINDOW) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, next_shard, slot) for every row.

    size: UTF-8 bytes of the text, a null text has none, and ``OVERHEAD``; slot: place in the
    shard; next_shard: where the map's second version, with one more shard, has the row. A null id
    is an id like any other; repeated rows are rows of their own; an empty table gives an empty
    result; other columns are not read.
    """
    maps = maps or SlotMaps(docs.sparkSession)
    rows, loads = slotted(docs, slots, id_column, text_column, crowd)
    first = first_map(loads, shards, slots)
    maps.write(1, first)
    maps.write(2, grown(first, loads))
    both = maps.read(1).join(maps.read(2).withColumnRenamed("shard", "next_shard"), "virtual_slot")
    return placed(rows, both, sum(s.rows for s in loads), slots, per_window)
