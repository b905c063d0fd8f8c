"""What reviewers look at: the explorer, the review queue, indicators and the coverage matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.loose_json import string_items
from goldsieve.functions.text import or_word
from goldsieve.operators.pending import with_interaction
from goldsieve.fixed import DIFFICULTIES, NOISE


def explorer(
    evals: DataFrame, interactions: DataFrame, scores: DataFrame, golden: DataFrame, multi: DataFrame
) -> DataFrame:
    """Every eval with its log, score, reference and assertions where present."""
    joined = (
        evals.join(scores.select("eval_id", "status", "agreement_ratio"), "eval_id", "left")
        .join(golden.select("eval_id", "golden_answer", "rubric_score_5"), "eval_id", "left")
        .join(
            multi.select("eval_id", "expected_behavior", "must_contain", "must_not_contain"), "eval_id", "left"
        )
    )
    texts = [c for c in ("user_prompt", "model_response", "log_ts") if c in interactions.columns]
    return with_interaction(joined, interactions, texts).drop("interaction_id")


def filter_explorer(
    view: DataFrame, status: str | None = "approved", categories: list[str] | None = None,
    difficulties: list[str] | None = None, min_quality: int = 1,
) -> DataFrame:
    """Status, category, difficulty and quality filters; an empty choice keeps everything."""
    if status:
        view = view.filter(F.col("status") == status)
    if categories:
        view = view.filter(F.col("category").isin(categories))
    if difficulties:
        view = view.filter(F.col("difficulty").isin(difficulties))
    return view.filter(F.col("quality_score") >= min_quality)


def filter_options(evals: DataFrame, scores: DataFrame) -> DataFrame:
    """The categories and difficulties that occur among approved evals."""
    approved = scores.filter(F.col("status") == "approved").select("eval_id")
    pairs = evals.join(approved, "eval_id").select(
        F.explode(
            F.array(
                F.struct(F.lit("category").alias("field"), F.col("category").alias("value")),
                F.struct(F.lit("difficulty").alias("field"), F.col("difficulty").alias("value")),
            )
        ).alias("o")
    )
    return pairs.select("o.field", "o.value").distinct()


def review_queue_view(
    queue: DataFrame, evals: DataFrame, interactions: DataFrame, scores: DataFrame
) -> DataFrame:
    """Unreviewed queue rows with texts and the proposed labels."""
    todo = queue.filter(F.col("reviewed") == 0)
    joined = todo.join(evals.select("eval_id", "interaction_id"), "eval_id").join(
        scores.select("eval_id", "majority_category", "majority_behavior", "agreement_ratio"), "eval_id"
    )
    return with_interaction(joined, interactions, ["user_prompt", "model_response"]).drop("interaction_id")


def curation_kpis(evals: DataFrame, scores: DataFrame) -> DataFrame:
    """Evals in total, approved and rejected."""
    status = evals.select("eval_id").join(scores.select("eval_id", "status"), "eval_id", "left")
    return status.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def coverage_matrix(evals: DataFrame, difficulties: list[str] | None = None) -> DataFrame:
    """Counts of category by difficulty, zero where a cell is empty."""
    listed = difficulties or DIFFICULTIES
    return evals.groupBy("category").agg(
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in listed]
    )


def label_crosstab(labels: DataFrame) -> DataFrame:
    """``category, difficulty, count`` for all categories and all difficulties that occur, zero where a cell is empty.

    Rows without a category or difficulty are left out. The values come from the labels, so failed ones show too.
    """
    known = labels.filter("category IS NOT NULL AND difficulty IS NOT NULL")
    counts = known.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.collect_set("difficulty")).scalar()
    cells = counts.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("difficulty", "n"))).alias("cells"))
    every = cells.select("category", "cells", F.explode(seen).alias("difficulty"))
    return every.select("category", "difficulty", F.coalesce(F.try_element_at("cells", F.col("difficulty")), F.lit(0)).cast("bigint").alias("count"))


def assertion_text(view: DataFrame) -> DataFrame:
    """Readable forms: items joined by ', ' or 'None', missing texts as 'N/A'."""

    def joined(column: str):
        items = string_items(F.col(column))
        return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit("None"))

    return view.withColumns(
        {
            "must_contain_text": joined("must_contain"),
            "must_not_contain_text": joined("must_not_contain"),
            "golden_text": or_word(F.col("golden_answer"), "N/A"),
            "rubric_text": or_word(F.col("rubric_score_5"), "N/A"),
        }
    )


def novelty_summary(assigned: DataFrame) -> DataFrame:
    """Clustered rows, noise rows and distinct clusters."""
    noise = F.col("cluster_id") == F.lit(NOISE)
    return assigned.filter(F.col("cluster_id").isNotNull()).agg(
        F.count(F.lit(1)).alias("clustered"), F.count_if(noise).alias("outliers"),
        F.countDistinct(F.when(~noise, F.col("cluster_id"))).alias("clusters"),
    )
