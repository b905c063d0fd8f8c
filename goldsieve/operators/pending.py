"""Finding the work that is left: filters and anti joins between the stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.fixed import NEGATIVE_FEEDBACK, NOISE
from goldsieve.operators.ingest import without


def to_cluster(normalized: DataFrame) -> DataFrame:
    """Sampled logs without a cluster."""
    return normalized.filter((F.col("is_sampled") == 1) & F.col("cluster_id").isNull())


def to_label(normalized: DataFrame, evals: DataFrame, *keep: str) -> DataFrame:
    """Novel or badly received logs without a label (``id`` and ``keep``, both texts by default); sampling plays no part here."""
    signal = (F.col("cluster_id") == NOISE) | F.col("user_feedback").isin(NEGATIVE_FEEDBACK)
    wanted = normalized.filter(signal).select("id", *(keep or ("user_prompt", "model_response")))
    return without(wanted, "id", evals.select("interaction_id"))


def with_interaction(evals: DataFrame, interactions: DataFrame, columns: list[str]) -> DataFrame:
    """Evals joined with columns of the log they came from."""
    texts = interactions.select(F.col("id").alias("interaction_id"), *columns)
    return evals.join(texts, "interaction_id")


def lacking(evals: DataFrame, done: DataFrame, interactions: DataFrame, *keep: str) -> DataFrame:
    """Evals without a row in ``done``, with both texts. The anti join runs on narrow rows first."""
    todo = evals.select("eval_id", "interaction_id", *keep).join(done.select("eval_id"), "eval_id", "left_anti")
    return with_interaction(todo, interactions, ["user_prompt", "model_response"]).select(
        "eval_id", "user_prompt", "model_response", *keep
    )


def approved(evals: DataFrame, scores: DataFrame, interactions: DataFrame) -> DataFrame:
    """Approved evals with their prompt."""
    ids = scores.filter(F.col("status") == "approved").select("eval_id")
    kept = evals.select("eval_id", "interaction_id").join(ids, "eval_id")
    return with_interaction(kept, interactions, ["user_prompt"]).select("eval_id", "user_prompt")


def approved_unchecked(
    evals: DataFrame, scores: DataFrame, interactions: DataFrame, dedup_log: DataFrame
) -> DataFrame:
    """Approved evals the duplicate check has not seen."""
    seen = dedup_log.select(F.col("candidate_eval_id").alias("eval_id"))
    todo = evals.join(seen, "eval_id", "left_anti")
    return approved(todo, scores, interactions)
