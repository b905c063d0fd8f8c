"""Comparing two evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.fixed import RATE_SHIFT, REASON_CHARS, SCORE_SHIFT


def latest_two(runs: DataFrame) -> DataFrame:
    """The two most recently completed runs, newest first."""
    done = runs.filter(F.col("completed_at").isNotNull())
    return done.orderBy(F.desc("completed_at"), F.desc("run_id")).limit(2).select(
        "run_id", "model_name", "completed_at"
    )


def results_of(results: DataFrame, run_id: str) -> DataFrame:
    """The results of one run; the filter reaches the scan."""
    return results.filter(F.col("run_id") == run_id)


def repeated_cases(results: DataFrame) -> DataFrame:
    """Cases a run holds more than once; a comparison needs this to be empty."""
    return results.groupBy("run_id", "eval_case_id").count().filter(F.col("count") > 1)


def compare(results: DataFrame, new_run: str, old_run: str) -> DataFrame:
    """One row per case of either run with both sides' values, from one scan and one shuffle.

    Both runs are filtered in the scan and meet in a single aggregation on the case, so neither side
    is joined or read twice.
    """
    both = results.filter(F.col("run_id").isin(new_run, old_run))
    is_new, is_old = F.col("run_id") == new_run, F.col("run_id") == old_run

    def side(which: Column, name: str) -> Column:
        return F.max(F.when(which, F.col(name)))

    return both.groupBy("eval_case_id").agg(
        F.count_if(is_new).alias("in_new"), F.count_if(is_old).alias("in_old"),
        side(is_new, "category").alias("category"), side(is_new, "difficulty").alias("difficulty"),
        side(is_old, "score").alias("old_score"), side(is_new, "score").alias("new_score"),
        side(is_old, "passed").alias("old_passed"), side(is_new, "passed").alias("new_passed"),
        side(is_new, "reasoning").alias("reasoning"),
    )


def run_coverage(compared: DataFrame) -> DataFrame:
    """How many cases the runs share, and how many are only in one of them."""
    new, old = F.col("in_new") > 0, F.col("in_old") > 0
    return compared.agg(
        F.count_if(new & old).alias("shared"), F.count_if(new & ~old).alias("added"),
        F.count_if(old & ~new).alias("removed"),
    )


def transitions(compared: DataFrame, score_shift: int = SCORE_SHIFT) -> DataFrame:
    """The class of each shared case. A pass/fail change wins over a score change."""
    shared = compared.filter((F.col("in_new") > 0) & (F.col("in_old") > 0))
    was, now = F.col("old_passed") == 1, F.col("new_passed") == 1
    delta = F.col("new_score") - F.col("old_score")
    change = (
        F.when(was & ~now, "regression").when(~was & now, "improvement")
        .when(F.abs(delta) > score_shift, "score_shift").otherwise("unchanged")
    )
    return shared.select(
        "eval_case_id", "category", "difficulty", "old_score", "new_score",
        delta.alias("delta"), change.alias("transition"), "reasoning",
    )


def regressions(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("transition") == "regression").select(
        "eval_case_id", "category", "difficulty", "old_score", "new_score",
        F.substring("reasoning", 1, REASON_CHARS).alias("reason"),
    )


def improvements(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("transition") == "improvement").select(
        "eval_case_id", "category", "difficulty", "old_score", "new_score"
    )


def score_shifts(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("transition") == "score_shift").select(
        "eval_case_id", "category", "difficulty", "old_score", "new_score", "delta",
        F.when(F.col("delta") > 0, "up").otherwise("DOWN").alias("direction"),
    )


def category_rates(results: DataFrame, new_run: str, old_run: str) -> DataFrame:
    """Pass rate of every category in both runs; NULL where a run lacks the category."""
    is_new, is_old = F.col("run_id") == new_run, F.col("run_id") == old_run

    def rate(which: Column) -> Column:
        return F.avg(F.when(which, F.col("passed").cast("double")))

    return (
        results.filter(F.col("run_id").isin(new_run, old_run))
        .groupBy("category")
        .agg(rate(is_old).alias("old_rate"), rate(is_new).alias("new_rate"))
    )


def category_shift(rates: DataFrame, threshold: float = RATE_SHIFT) -> DataFrame:
    """Categories present in both runs with the change of their rate and a strict flag, in order."""
    both = rates.filter(
        F.col("category").isNotNull() & F.col("old_rate").isNotNull() & F.col("new_rate").isNotNull()
    )
    delta = F.col("new_rate") - F.col("old_rate")
    flag = F.when(delta < -threshold, "WARNING").when(delta > threshold, "IMPROVED").otherwise("")
    return both.select("category", "old_rate", "new_rate", delta.alias("delta"), flag.alias("flag")).orderBy("category")


def all_categories(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("category").union(old.select("category")).distinct()


def regression_summary(changes: DataFrame, new_run: str, old_run: str) -> DataFrame:
    """The report row of one comparison."""
    is_a = lambda name: F.count_if(F.col("transition") == name)
    return changes.agg(
        is_a("regression").alias("new_failures"), is_a("improvement").alias("new_passes"),
        is_a("score_shift").alias("score_shifts"),
    ).select(F.lit(new_run).alias("run_id_new"), F.lit(old_run).alias("run_id_old"), "*")
