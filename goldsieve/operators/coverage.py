"""Coverage of the approved set: counts per cell, thin cells, gaps, quotas and filling them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from goldsieve.functions.text import unit_hash
from goldsieve.fixed import COVERAGE_CATEGORIES, MIN_PER_CELL, OVERDRAW, THIN_CELL


def accepted_or_unchecked(frame: DataFrame, dedup_log: DataFrame) -> DataFrame:
    """Drop evals whose logged checks are all rejections; an eval without a log row stays."""
    log = dedup_log.select(F.col("candidate_eval_id").alias("eval_id"), "action")
    return frame.join(log, "eval_id", "left").filter(
        (F.col("action") == "accepted") | F.col("action").isNull()
    ).drop("action")


def counted_evals(evals: DataFrame, scores: DataFrame, dedup_log: DataFrame) -> DataFrame:
    """The evals that coverage counts, with their cell and agreement."""
    approved = scores.filter(F.col("status") == "approved").select("eval_id", "agreement_ratio")
    return accepted_or_unchecked(evals.select("eval_id", "category", "difficulty").join(approved, "eval_id"), dedup_log)


def coverage_report(evals: DataFrame, scores: DataFrame, dedup_log: DataFrame) -> DataFrame:
    """Count and mean agreement per (category, difficulty), smallest cells first."""
    return (
        counted_evals(evals, scores, dedup_log).groupBy("category", "difficulty")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("agreement_ratio").alias("avg_confidence"))
        .orderBy("count", "category", "difficulty")
    )


def coverage_state(counted: DataFrame) -> DataFrame:
    """What a report can be carried on from: per cell the evals, those with an agreement, and the sum of agreements."""
    return counted.groupBy("category", "difficulty").agg(
        F.count(F.lit(1)).alias("count"), F.count("agreement_ratio").alias("scored"), F.coalesce(F.sum("agreement_ratio"), F.lit(0.0)).alias("total")
    )


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """By how much cells change when of some evals the counted rows were ``before`` and are ``after``.

    Only changed evals are given; one that is no longer counted, or changes its cell, is taken out where it was.
    """
    out = [F.lit(-1).alias("sign"), "category", "difficulty", "agreement_ratio"]
    moved = before.select(*out).unionByName(after.select(F.lit(1).alias("sign"), *out[1:]))
    known = F.col("agreement_ratio").isNotNull().cast("bigint")
    return moved.groupBy("category", "difficulty").agg(
        F.sum("sign").alias("count"), F.sum(F.col("sign") * known).alias("scored"),
        F.coalesce(F.sum(F.col("sign") * F.col("agreement_ratio")), F.lit(0.0)).alias("total"),
    )


def apply_delta(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta; cells without evals go."""
    columns = ["category", "difficulty", "count", "scored", "total"]
    added = state.select(columns).unionByName(delta.select(columns)).groupBy("category", "difficulty").agg(
        *(F.sum(c).alias(c) for c in columns[2:]))
    return added.filter(F.col("count") > 0)


def report_of(state: DataFrame) -> DataFrame:
    """The coverage report of a state."""
    mean = F.when(F.col("scored") > 0, F.col("total") / F.col("scored"))
    return state.select("category", "difficulty", "count", mean.alias("avg_confidence")).orderBy("count", "category", "difficulty")


def flag_thin(report: DataFrame, below: int = THIN_CELL) -> DataFrame:
    return report.withColumn("needs_more", F.col("count") < below)


def coverage_gaps(
    report: DataFrame, minimum: int = MIN_PER_CELL, categories: list[str] | None = None
) -> DataFrame:
    """Cells below the minimum, and listed categories that are absent altogether."""
    listed = COVERAGE_CATEGORIES if categories is None else categories
    spark = report.sparkSession
    wanted = spark.createDataFrame([(c,) for c in dict.fromkeys(listed)], "category string")
    absent = F.col("count").isNull()
    # One join instead of a union, so that the report is computed once.
    return report.join(wanted, "category", "full_outer").filter(absent | (F.col("count") < minimum)).select(
        "category", F.when(absent, "simple").otherwise(F.col("difficulty")).alias("difficulty"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        (F.lit(minimum) - F.coalesce("count", F.lit(0))).cast("bigint").alias("needed"),
    )


def gap_quota(gaps: DataFrame, overdraw: int = OVERDRAW) -> DataFrame:
    """How many logs to draw per gap, leaving room for later filtering."""
    return gaps.withColumn("quota", F.col("needed") * overdraw)


def top_up(quotas: DataFrame, pool: DataFrame, seed: int = 42, salts: int | None = None) -> DataFrame:
    """Up to the quota of logs per category, picked by a repeatable hash order.

    The ranking runs twice: within hashed slices of a category first, so that a category holding a large
    share of the pool is spread over as many tasks as a shuffle has, then over the few survivors of each slice. The quota is
    joined on category and slice, so the pool is never shuffled by category alone.
    """
    salts = salts or int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = quotas.groupBy("category").agg(F.sum("quota").alias("quota")).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    order = [F.col("_u"), F.col("id")]
    sliced = pool.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    ranked = (
        sliced.join(wanted, ["category", "_slice"])
        .withColumn("_u", unit_hash(F.col("id"), seed))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("category", "_slice").orderBy(*order)))
        .filter(F.col("_rank") <= F.col("quota"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
        .filter(F.col("_rank") <= F.col("quota"))
    )
    return ranked.drop("_u", "_slice", "_rank", "quota")
