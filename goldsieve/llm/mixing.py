"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. The document rates closest to 1 in relative entropy that meet the targets
are exponentially tilted, ``min(most, exp(lambda * size / mean size))`` with one ``lambda`` a source: the maximiser of a
concave dual. Newton steps (kept inside a bracket) find all of them at once, each step one distributed sum
over the table of (source, size, documents). Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.llm.common import WORD, partitions, stored

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
ROUNDS = 200


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MOST) -> list[float]:
    """Shares of ``share`` of all words by weight; what is above ``most`` times a source's size is shared again."""
    left, capped, open_ = share * sum(sizes), {}, list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            return [capped.get(i, unit * weights[i]) for i in range(len(sizes))]
        for i in over:
            capped[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in capped]
        left = share * sum(sizes) - sum(capped.values())
    return [capped[i] for i in range(len(sizes))]


@dataclass
class Dual:
    """One source's multiplier and the bracket it lies in."""

    value: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    def step(self, words: float, slope: float, target: float) -> None:
        if abs(words - target) <= 1e-9 * max(target, 1.0):
            self.done = True
            return
        if words < target:
            self.low = self.value
        else:
            self.high = self.value
        new = self.value + (target - words) / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low) or math.isinf(self.high):
                reach = 1.0 + abs(self.value)
                new = self.value + (reach if words < target else -reach)
            else:
                new = (self.low + self.high) / 2
        self.done = new == self.value or self.high - self.low <= 1e-13 * max(1.0, abs(new))
        self.value = new


def solve(sizes: DataFrame, wanted: dict[int, float], means: dict[int, float], most: float = MOST) -> dict[int, float]:
    """``lambda`` by source for rows ``src, size, n``; infinite where only the full rate meets the target.

    Each step sends the multipliers out and brings one sum and one slope per source back.
    """
    spark, totals = sizes.sparkSession, {r.src: r.words for r in sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    full = {s for s, t in wanted.items() if t >= most * totals.get(s, 0) * (1 - 1e-12)}
    duals = {s: Dual() for s in wanted if s not in full}
    for _ in range(ROUNDS):
        active = [(s, d.value, means[s]) for s, d in duals.items() if not d.done]
        if not active:
            break
        at = F.broadcast(spark.createDataFrame(active, "src int, lambda double, mean double"))
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lambda") * x, F.lit(math.log(most) + 1)))
        words = F.col("n") * F.col("size") * F.least(F.lit(float(most)), rate)
        slope = F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        for r in sizes.join(at, "src").groupBy("src").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")).collect():
            duals[r.src].step(r.words, r.slope, wanted[r.src])
    return {s: math.inf for s in full} | {s: d.value for s, d in duals.items()}


def rounder(most: int):
    """Whole copies for each size of one source: the rounding error of longer documents is made up by shorter ones.

    A group holds one row per distinct size of a source, however many documents there are.
    """

    def round_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows, carry, copies = rows.sort_values("size", ascending=False), 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
            low = math.floor(rate)
            least, top = n * low, n * min(most, low + (rate > low))
            want = n * rate + (carry / size if size else 0.0)
            taken = min(max(round(want), least), top)
            carry += (n * rate - taken) * size
            copies.append(taken)
        return pd.DataFrame({
            "src": rows["src"], "size": rows["size"], "every": [c // n for c, n in zip(copies, rows["n"].tolist())],
            "extra": [c % n for c, n in zip(copies, rows["n"].tolist())],
        })

    return round_source


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST,
    text: str = "text", key: str = "doc_id", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``key, size, source_size, target, copies, taken`` and the ``carry`` columns.

    ``size`` is the number of words (null: 0), ``taken`` is ``copies * size``. Sources in code point order, null last as
    a source of its own, get ``weights`` in turn. A document without words is taken once, or ``most`` times from a
    source that is taken in full. Which documents of a size get the further copy follows from a hash of the key (then
    of the text), so reruns agree; identical rows are interchangeable. Rows with null or repeated keys count like
    any other. Only the three columns and what is carried are read. Empty tables give no rows. The sources themselves, one
    name and weight each, are listed on the driver, as weights are.
    """
    spark, slices = docs.sparkSession, partitions(docs.sparkSession)
    narrow = [
        F.col(key).alias("id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    ]
    rows = stored(docs.select(*narrow), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.words for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, most)
    listed = spark.createDataFrame(
        [(i, r.source, r.words, t) for i, (r, t) in enumerate(zip(sums, wanted))],
        "src int, source_name string, source_size bigint, target double",
    )

    def numbered(frame: DataFrame, *carried: str) -> DataFrame:
        return frame.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("source_name"))).select(
            "id", "src", "size", "text_hash", "source_size", "target", *carried,
            F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(slices)).alias("slice"),
        )

    cells = stored(numbered(rows).groupBy("src", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = stored(cells.groupBy("src", "size").agg(F.sum("n").alias("n")), "histogram")
    means = {i: max(r.words / r.docs, 1e-9) for i, r in enumerate(sums)}
    duals = solve(sizes, dict(enumerate(wanted)), means, most)
    tilted = F.broadcast(spark.createDataFrame([(s, v, means[s]) for s, v in duals.items()], "src int, lambda double, mean double"))
    rate = F.when(F.col("lambda") == math.inf, F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(math.log(most) + 1))))
    )
    rounded = sizes.join(tilted, "src").select("src", "size", "n", rate.alias("rate")).groupBy("src").applyInPandas(
        rounder(most), "src int, size bigint, every bigint, extra bigint"
    )

    before = Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    plan = starts.join(rounded, ["src", "size"])
    place = Window.partitionBy("src", "size", "slice").orderBy(F.xxhash64("id"), F.col("id"), F.col("text_hash"))
    names = [f"_{i}" for i in range(len(carry))]
    whole = docs.select(*narrow, *(F.col(c).alias(n) for c, n in zip(carry, names))) if carry else rows
    ranked = numbered(whole, *names).withColumn("place", F.row_number().over(place)).join(plan, ["src", "size", "slice"])
    copies = F.col("every") + (F.col("start") + F.col("place") <= F.col("extra")).cast("bigint")
    return ranked.withColumn("copies", copies).select(
        F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *(F.col(n).alias(c) for n, c in zip(names, carry)),
    )
