"""Evaluation of model responses: cases, assertions, the pass rule and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.loose_json import string_items
from goldsieve.operators.coverage import accepted_or_unchecked
from goldsieve.operators.judge import reference_text
from goldsieve.operators.pending import with_interaction
from goldsieve.fixed import PASS_SCORE


def one_per_eval(frame: DataFrame, *columns: str) -> DataFrame:
    """One row per eval of a table that should have one; equal keys keep their smallest row."""
    row = F.struct(*columns)
    return frame.groupBy("eval_id").agg(F.min(row).alias("_row")).select(
        "eval_id", *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def eval_cases(
    evals: DataFrame, interactions: DataFrame, scores: DataFrame, golden: DataFrame, multi: DataFrame,
    dedup_log: DataFrame,
) -> DataFrame:
    """Approved, not rejected as duplicates, with prompt, reference and assertions where present.

    All joins but the last run on ``eval_id``; the prompt text joins last, to the surviving rows only.
    """
    approved = scores.filter(F.col("status") == "approved").select("eval_id")
    kept = accepted_or_unchecked(
        evals.select("eval_id", "interaction_id", "category", "difficulty").join(approved, "eval_id"), dedup_log
    )
    labeled = kept.join(
        multi.select("eval_id", "must_contain", "must_not_contain", "expected_behavior"), "eval_id", "left"
    ).join(golden.select("eval_id", "golden_answer", "rubric_score_5"), "eval_id", "left")
    return with_interaction(labeled, interactions, ["user_prompt"]).select(
        "eval_id", "category", "difficulty", "user_prompt", "golden_answer", "rubric_score_5",
        "must_contain", "must_not_contain", "expected_behavior",
    )


def first_cases(cases: DataFrame, limit: int | None) -> DataFrame:
    """The ``limit`` lowest eval ids; all cases when no limit is set."""
    return cases if not limit else cases.orderBy("eval_id").limit(limit)


def with_reference(cases: DataFrame) -> DataFrame:
    return cases.withColumn("reference", reference_text(F.col("golden_answer"), F.col("rubric_score_5")))


def check_assertions(responses: DataFrame) -> DataFrame:
    """Every required text present, no forbidden text present, ignoring case; empty lists pass."""
    answer = F.lower(F.coalesce("model_response", F.lit("")))

    def found(item):
        return F.contains(answer, F.lower(item))

    return responses.withColumns(
        {
            "must_contain_pass": F.forall(string_items(F.col("must_contain")), found),
            "must_not_contain_pass": ~F.exists(string_items(F.col("must_not_contain")), found),
        }
    )


def apply_pass_rule(scored: DataFrame, minimum: int = PASS_SCORE, verdict: str = "rule") -> DataFrame:
    """A case passes with a high score and both assertion checks, or with ``verdict="judge"`` when the judge says so."""
    if verdict not in ("rule", "judge"):
        raise ValueError(f"verdict is {verdict!r}, not rule or judge")
    if verdict == "judge":
        return scored.withColumn("passed", F.coalesce("judge_passed", F.lit(False)))
    rule = (F.col("score") >= minimum) & F.col("must_contain_pass") & F.col("must_not_contain_pass")
    return scored.withColumn("passed", F.coalesce(rule, F.lit(False)))


def run_summary(results: DataFrame) -> DataFrame:
    """Total, passed, failed and pass rate per run."""
    passed, total = F.sum(F.col("passed").cast("bigint")), F.count(F.lit(1))
    return results.groupBy("run_id").agg(
        total.alias("total_cases"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        F.coalesce(F.try_divide(passed.cast("double"), total.cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def breakdown(results: DataFrame) -> DataFrame:
    """Passed, count and pass rate per run, category and difficulty; rows without a key are left out."""
    passed, total = F.sum(F.col("passed").cast("bigint")), F.count(F.lit(1))
    return (
        results.dropna(subset=["category", "difficulty"])
        .groupBy("run_id", "category", "difficulty")
        .agg(
            passed.alias("passed"), total.alias("count"),
            (passed.cast("double") / total.cast("double")).alias("pass_rate"),
        )
    )
