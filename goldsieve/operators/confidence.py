"""Vote agreement, routing and review transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.text import percent_text
from goldsieve.operators.upkeep import one_per_key
from goldsieve.fixed import APPROVAL_AGREEMENT, DEFAULT_BEHAVIOR, DEFAULT_CATEGORY, REVIEW_REASON


def fan_out_votes(evals: DataFrame, runs: int) -> DataFrame:
    """``runs`` rows per eval, numbered from 1."""
    return evals.withColumn("run_idx", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def majority(votes: DataFrame, evals: DataFrame | None = None) -> DataFrame:
    """Per eval: runs, agreement and, independently, the majority category and behavior.

    Failed votes (NULL) count as runs. Ties go to the value seen in the lowest run. The first
    aggregation combines on the map side, so an eval with very many votes shrinks to its distinct
    values before it meets in one task.
    """
    fields = F.array(
        F.struct(F.lit("category").alias("field"), F.col("category").alias("value")),
        F.struct(F.lit("behavior").alias("field"), F.col("behavior").alias("value")),
    )
    counted = (
        votes.select("eval_id", "run_idx", F.explode(fields).alias("vote"))
        .groupBy("eval_id", "vote.field", "vote.value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("run_idx").alias("first_run"))
    )
    rank = F.struct("n", -F.col("first_run"))

    def top(field: str, what) -> F.Column:
        mine = (F.col("field") == field) & F.col("value").isNotNull()
        return F.max_by(F.when(mine, what), F.when(mine, rank))

    is_category = F.col("field") == "category"
    result = counted.groupBy("eval_id").agg(
        F.sum(F.when(is_category, F.col("n"))).cast("int").alias("num_runs"),
        top("category", F.col("n")).alias("top"),
        top("category", F.col("value")).alias("majority_category"),
        top("behavior", F.col("value")).alias("majority_behavior"),
    )
    if evals is not None:
        result = evals.select("eval_id").join(result, "eval_id", "left")
    no_category = F.col("majority_category").isNull()
    return result.select(
        "eval_id",
        F.coalesce("num_runs", F.lit(0)).alias("num_runs"),
        F.coalesce(F.col("top").cast("double") / F.col("num_runs"), F.lit(0.0)).alias("agreement_ratio"),
        F.coalesce("majority_category", F.lit(DEFAULT_CATEGORY)).alias("majority_category"),
        F.when(no_category | F.col("majority_behavior").isNull(), F.lit(DEFAULT_BEHAVIOR))
        .otherwise(F.col("majority_behavior"))
        .alias("majority_behavior"),
    )


def with_status(scores: DataFrame, threshold: float = APPROVAL_AGREEMENT) -> DataFrame:
    return scores.withColumn(
        "status", F.when(F.col("agreement_ratio") >= threshold, "approved").otherwise("needs_review")
    )


def review_queue(scores: DataFrame) -> DataFrame:
    """One queue row with its reason per eval that needs review."""
    reason = F.format_string(REVIEW_REASON, percent_text(F.col("agreement_ratio")), F.col("num_runs").cast("string"))
    return scores.filter(F.col("status") == "needs_review").select(
        "eval_id", reason.alias("reason"), F.lit(0).alias("reviewed")
    )


def apply_decisions(scores: DataFrame, queue: DataFrame, decisions: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Approve or reject evals; every queue row of a decided eval becomes reviewed.

    Of several decisions on an eval the last by ``order`` (columns of ``decisions``) counts.
    """
    decisions = one_per_key(decisions.select("eval_id", "decision", *order), "eval_id", *order).select("eval_id", "decision")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected")
    new_scores = scores.join(decisions, "eval_id", "left").withColumn(
        "status", F.coalesce(status, F.col("status"))
    )
    decided = decisions.select("eval_id", F.lit(1).alias("_decided"))
    new_queue = queue.join(decided, "eval_id", "left").withColumn("reviewed", F.coalesce("_decided", "reviewed"))
    return new_scores.drop("decision"), new_queue.drop("_decided")
