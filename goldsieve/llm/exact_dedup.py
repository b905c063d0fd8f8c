"""Exact duplicates by sorting the contents.

Rows are range-partitioned on the head of the normalised text (ties by a hash of all of it) with splitters that
Spark samples, sorted externally inside every range, and each row is compared with its neighbour on the whole
text: a run of equal texts is a group. No Python runs.

A text that a sample finds in a large share of the rows is cut into slices by row id, so that its run spreads over
many ranges; the slices, each one row by then, meet again by SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldsieve.llm.common import partitions, stored, text_of
from goldsieve.session import cut_lineage

#: Characters of a text that a splitter holds, so that the sampled splitters stay small.
HEAD = 32
#: One row in so many is sampled when hot texts are sought.
SAMPLE = 32


def _hot(rows: DataFrame, ranges: int) -> DataFrame:
    """Hashes of texts with a quarter of a range or more among sampled rows: at most ``4 * ranges`` rows."""
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    least = max(2, -(-sample.select("id").count() // (4 * ranges)))
    return cut_lineage(sample.groupBy("tie").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("tie"))


def exact_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are; null counts as empty, and empty texts form a group like any
    other. Of a group exactly one row is kept, that with the smallest (or ``keep="largest"``) key; a null key loses
    to any other, a group of null keys keeps one row with a null ``keep_id``, and of rows that repeat the winning
    key one is kept. Only ``text`` and ``key`` are read, so other columns cannot clash. No rows give no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, not smallest or largest")
    ranges = partitions(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), normalise(text_of(F.col(text))).alias("body")).select(
        "id", "body", F.xxhash64("body").alias("tie")
    )
    hot = _hot(rows, ranges).withColumn("hot", F.lit(True))
    cut = rows.join(F.broadcast(hot), "tie", "left").select(
        "id", "body", "tie", F.coalesce("hot", F.lit(False)).alias("hot"), F.left("body", F.lit(HEAD)).alias("head")
    ).withColumn("slice", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(ranges))).otherwise(0))
    ranged = cut.repartitionByRange(ranges, "head", "tie", "slice")

    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    run = Window.partitionBy("head", "tie", "slice", "body").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = stored(ranged.select(
        "id", "hot", F.first("id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("n"),
        F.row_number().over(run).alias("place"), F.unhex(F.sha2(F.col("body"), 256)).alias("digest"),
    ), "runs")

    best = F.max("best") if keep == "largest" else F.min("best")
    merged = runs.filter("hot and place = 1").groupBy("digest").agg(best.alias("all_best"), F.sum("n").alias("all_n"))
    return runs.join(F.broadcast(merged.withColumn("hot", F.lit(True))), ["digest", "hot"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("hot"), F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | F.col("best").eqNullSafe(F.col("all_best")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
