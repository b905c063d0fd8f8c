"""Running totals, dense numbers and exact weighted draws over any number of partitions.

Rows are dealt out by ranges of their keys, each range is summed, and the sums before a range are added to what a row finds within
it. Only one number a range reaches the driver; no task sees more than a range. Results depend on the order of keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.functions.text import unit_hash
from goldsieve.session import cut_lineage

#: Units of weight that share a bucket when draws meet the rows they hit.
BUCKET = 16


def running_totals(rows: DataFrame, weight: Column, *keys: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over all rows with lower keys. Keys must tell rows apart."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select(F.struct("*").alias("row"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), weight.cast("bigint").alias("w"))
    order = [f"k{i}" for i in range(len(keys))]
    dealt = cut_lineage(packed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sums = sorted((r.part, r.total or 0) for r in dealt.groupBy("part").agg(F.sum("w").alias("total")).collect())
    offsets, total = [], 0
    for part, here in sums:
        offsets.append((part, total))
        total += here
    starts = rows.sparkSession.createDataFrame(offsets, "part int, start bigint")
    earlier = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("w").over(earlier), F.lit(0))
    return dealt.withColumn("within", within).join(starts, "part").select("row.*", (F.col("start") + F.col("within")).alias("before"))


def dense_ids(rows: DataFrame, key: str, name: str, stored_ids: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with gapless numbers in the order of ``key``, from 1 or from the largest of ``stored_ids`` (its column ``name``) on."""
    top = 0 if stored_ids is None else stored_ids.agg(F.max(name)).first()[0] or 0
    numbered = running_totals(rows, F.lit(1), key, partitions=partitions)
    return numbered.withColumn(name, F.col("before") + 1 + top).drop("before")


def weighted_draws(
    rows: DataFrame, key: str, weight: str, fraction: float = 0.5, seed: int = 42, partitions: int | None = None,
) -> DataFrame:
    """``key, draws`` of the rows hit by exactly ``round(fraction * rows)`` draws with replacement (half to even).

    The chance of a row in a draw is its whole-number weight over the sum of weights. Rows lie side by side on a line in the order
    of their keys, as long as their weights; a draw is a point on it by a hash of its number. Points meet rows in
    buckets of a few units of length, so no bucket is large whatever the weights of others. Rows without weight are never hit.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(key).alias("id"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("weight"))
    n, total = narrow.agg(F.bround(F.lit(fraction) * F.count(F.lit(1)), 0).cast("bigint"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    placed = running_totals(narrow, F.col("weight"), "id", partitions=partitions).filter("weight > 0")
    ends = F.sequence(F.floor(F.col("before") / BUCKET), F.floor((F.col("before") + F.col("weight") - 1) / BUCKET))
    lying = placed.withColumn("bucket", F.explode(ends))
    number = F.concat(F.lit("draw"), F.col("id").cast("string"))
    points = spark.range(n if total else 0).select(F.floor(unit_hash(number, seed) * F.lit(float(total))).alias("point"))
    points = points.withColumn("bucket", F.floor(F.col("point") / BUCKET))
    hit = points.join(lying, "bucket").filter((F.col("point") >= F.col("before")) & (F.col("point") < F.col("before") + F.col("weight")))
    return hit.groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias("draws"))
