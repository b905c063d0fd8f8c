"""Shards of near-equal bytes by histogram sort.

The sort key is a hash of the text, so equal texts are neighbours and go to the same shard. Rounds of counting refine
candidate boundaries: every round counts the exact bytes between probes inside the intervals that still hold a
wanted boundary. Then every row knows its shard and the documents are exchanged once. No Python runs.

Groups of equal texts too heavy to balance are placed first, the largest on the least loaded shard, and the
boundaries fill what room is left. Only a group larger than a whole shard is split, by row id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.llm.common import partitions, stored, text_of

#: Probes in each interval and round; slices of a group that is larger than a shard.
PROBES, SLICES = 64, 256
TOP = 1 << 63


@dataclass
class Interval:
    low: int
    high: int
    below: int


def _count(light: DataFrame, intervals: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Exact bytes by (interval, probe bin); at most PROBES rows an interval come back."""
    cases = F.lit(None).cast("struct<at:int,bin:bigint>")
    for at, (low, high) in reversed(list(enumerate(intervals))):
        width = -(-(high - low) // PROBES)
        inside = (F.col("key") >= low) & (F.col("key") <= high - 1)
        cases = F.when(inside, F.struct(F.lit(at).alias("at"), F.expr(f"(key - {low}L) div {width}L").alias("bin"))).otherwise(cases)
    counted = light.select(cases.alias("c"), "size").filter("c is not null").groupBy("c.at", "c.bin").agg(F.sum("size").alias("bytes"))
    return {(r.at, r.bin): r.bytes for r in counted.collect()}


def splitters(light: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Key boundaries with about ``targets`` bytes below them, each within ``tolerance`` or at single-key grain."""
    found: dict[int, int] = {}
    active = {i: Interval(0, TOP, 0) for i in range(len(targets))}
    while active:
        wanted = sorted({(v.low, v.high) for v in active.values()})
        counts = _count(light, wanted)
        still = {}
        for i, interval in active.items():
            at, width = wanted.index((interval.low, interval.high)), -(-(interval.high - interval.low) // PROBES)
            below, low = interval.below, interval.low
            while low + width < interval.high and below + counts.get((at, (low - interval.low) // width), 0) <= targets[i]:
                below += counts.get((at, (low - interval.low) // width), 0)
                low += width
            here = counts.get((at, (low - interval.low) // width), 0)
            high = min(low + width, interval.high)
            if abs(targets[i] - below) <= tolerance:
                found[i] = low
            elif abs(below + here - targets[i]) <= tolerance:
                found[i] = high
            elif high - low <= 1:
                found[i] = low if targets[i] - below <= below + here - targets[i] else high
            else:
                still[i] = Interval(low, high, below)
        active = still
    return [found[i] for i in range(len(targets))]


def _place(items: list[tuple[int, int, int]], shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """The largest item to the least loaded shard, and so on."""
    heap, loads, placed = [(0, s) for s in range(shards)], [0] * shards, {}
    for size, key, slice_ in sorted(((b, k, s) for k, s, b in items), reverse=True):
        load, shard = heapq.heappop(heap)
        placed[key, slice_], loads[shard] = shard, load + size
        heapq.heappush(heap, (load + size, shard))
    return placed, loads


def shard_by_bytes(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with ``shard_bytes`` (of the text, plus 1), ``shard`` and ``slot``, gapless from 0.

    Every shard's bytes come within about ``tolerance`` of the mean, as far as whole rows allow. Equal texts share a
    shard unless they outweigh one; null counts as empty. Null and repeated keys are rows like any other (slots
    between identical rows are interchangeable). Columns of ``docs`` with the names of added ones are replaced; others are
    kept, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    place = F.xxhash64(text_of(F.col(text)))
    added = {
        "_key": F.shiftrightunsigned(place, 1), "shard_bytes": F.octet_length(text_of(F.col(text))).cast("bigint") + 1,
        "_slice": F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(SLICES)).cast("int"),
    }
    narrow = stored(docs.select(added["_key"].alias("key"), added["shard_bytes"].alias("size"), added["_slice"].alias("slice")), "sizes")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    mean = total / shards

    groups = narrow.groupBy("key").agg(F.sum("size").alias("bytes"))
    heavy = [(r.key, r.bytes) for r in groups.filter(F.col("bytes") > tolerance * mean).collect()]  # at most shards / tolerance
    giant = [k for k, b in heavy if b > mean]  # at most `shards`
    items = [(k, -1, b) for k, b in heavy if b <= mean]
    if giant:
        cut = narrow.filter(F.col("key").isin(giant)).groupBy("key", "slice").agg(F.sum("size").alias("bytes"))
        items += [(r.key, r.slice, r.bytes) for r in cut.collect()]
    placed, loads = _place(items, shards)

    heavy_keys = spark.createDataFrame(
        [(k, s, shard) for (k, s), shard in placed.items()], "key bigint, slice int, placed int"
    ).withColumn("whole", F.col("slice") < 0)
    light = narrow.join(F.broadcast(heavy_keys.select("key").distinct()), "key", "left_anti") if items else narrow
    room = [max(0.0, mean - load) for load in loads]
    scale = max(0, total - sum(loads)) / (sum(room) or 1)
    targets, below = [], 0.0
    for s in range(shards - 1):
        below += room[s] * scale
        targets.append(below)
    bounds = splitters(light, targets, tolerance * mean / 2) if total else [TOP] * (shards - 1)

    def at(key_: Column) -> Column:
        return reduce(lambda a, b: a + b, [(key_ >= b).cast("int") for b in bounds if b < TOP], F.lit(0))

    def sharded(rows: DataFrame, key_: str, slice_: str) -> DataFrame:
        """Adds ``_shard`` and ``_piece``; pieces only spread the numbering of a shard over tasks."""
        whole = F.broadcast(heavy_keys.filter("whole").select(F.col("key").alias(key_), F.col("placed").alias("_whole")))
        parts = F.broadcast(heavy_keys.filter("not whole").select(F.col("key").alias(key_), F.col("slice").alias(slice_), F.col("placed").alias("_part")))
        out = rows.join(whole, key_, "left").join(parts, [key_, slice_], "left")
        return out.withColumn("_shard", F.coalesce("_whole", "_part", at(F.col(key_)))).withColumn(
            "_piece", F.pmod(F.xxhash64(F.col(key_), F.col(slice_)), F.lit(pieces)).cast("int")
        ).drop("_whole", "_part")

    pieces = max(1, -(-4 * partitions(spark) // shards))
    counts = sharded(narrow, "key", "slice").groupBy("_shard", "_piece").agg(F.count(F.lit(1)).alias("n")).collect()
    base, offsets = dict.fromkeys(range(shards), 0), []  # shards * pieces rows
    for r in sorted(counts, key=lambda r: (r["_shard"], r["_piece"])):
        offsets.append((r["_shard"], r["_piece"], base[r["_shard"]]))
        base[r["_shard"]] += r.n
    first = F.broadcast(spark.createDataFrame(offsets, "_shard int, _piece int, _base bigint"))

    names = [c for c in docs.columns if c not in ("shard_bytes", "shard", "slot")]
    rows = docs.select(F.struct(*names).alias("row"), F.col(key).alias("id"), *(c.alias(n) for n, c in added.items()))
    order = Window.partitionBy("_shard", "_piece").orderBy("_key", "id")
    exchanged = sharded(rows, "_key", "_slice").repartition(partitions(spark), "_shard", "_piece")
    numbered = exchanged.withColumn("_row", F.row_number().over(order)).join(first, ["_shard", "_piece"])
    return numbered.select(
        "row.*", "shard_bytes", F.col("_shard").alias("shard"), (F.col("_base") + F.col("_row") - 1).alias("slot"),
    )
