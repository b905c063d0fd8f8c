"""Ingest: new logs only, redacted, scored by signal and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.functions.text import redact_pii, token_estimate, unit_hash
from goldsieve.fixed import NEGATIVE_FEEDBACK, SLOW_MS


def without(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose key is not the one column of ``known``: a left anti join, never NOT IN, so a row without a key stays.

    Written as NOT EXISTS, which Spark takes below the expressions and joins that make wide columns, to the narrow rows the key is from.
    """
    same = F.col("_known") == F.col(f"_rows.{key}").outer()
    return rows.alias("_rows").filter(~known.toDF("_known").filter(same).exists())


def new_logs(raw: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Logs whose id has not been ingested; see ``without``."""
    return without(raw, "id", known_ids.select("id"))


def distinct_logs(logs: DataFrame) -> DataFrame:
    """One row per id, the same in every run: the earliest, then that with the smallest hash of the whole row.

    The choice is made on narrow rows that combine on the map side; the texts of the chosen rows move once.
    """
    time = ["log_ts"] if "log_ts" in logs.columns else []
    place = F.struct(*time, F.xxhash64(*logs.columns).alias("hash"))
    marked = logs.withColumn("_place", place)
    first = marked.groupBy("id").agg(F.min("_place").alias("_first"))
    chosen = marked.join(first, "id").filter(F.col("_place").eqNullSafe(F.col("_first")))
    return chosen.drop("_place", "_first").dropDuplicates(["id"])


def redact(logs: DataFrame, columns: tuple[str, ...] = ("user_prompt", "model_response")) -> DataFrame:
    return logs.withColumns({c: redact_pii(F.col(c)) for c in columns})


def priority_of(feedback: Column, latency: Column) -> Column:
    """1, or 5 after negative feedback; 2 more when the answer was slow."""
    base = F.when(feedback.isin(NEGATIVE_FEEDBACK), 5).otherwise(1)
    return base + F.when(latency > SLOW_MS, 2).otherwise(0)


def with_priority(logs: DataFrame) -> DataFrame:
    return logs.withColumn("priority_score", priority_of(F.col("user_feedback"), F.col("latency_ms")))


def sampling_totals(scored: DataFrame, fraction: float = 0.5) -> DataFrame:
    """One row: the number of draws (half-even rounding of the share) and the total weight."""
    return scored.agg(
        F.bround(F.lit(fraction) * F.count(F.lit(1)), 0).alias("draws"),
        F.sum("priority_score").cast("double").alias("weight"),
    )


def mark_sampled(scored: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """Flag each row 0/1 with the chance that ``draws`` weighted draws with replacement hit it.

    The totals come from a one-row scalar subquery over the narrow columns; the flag itself is a
    per-row expression, so the wide rows are neither sorted nor shuffled for sampling.
    """
    totals = sampling_totals(scored.select("user_feedback", "latency_ms", "priority_score"), fraction)
    both = totals.select(F.struct("draws", "weight")).scalar()
    draws, share = both["draws"], F.col("priority_score") / both["weight"]
    # 1 - (1 - share)^draws, written so that tiny shares keep their digits.
    chance = F.when(draws == 0, F.lit(0.0)).when(share >= 1, F.lit(1.0)).otherwise(
        -F.expm1(draws * F.log1p(-share))
    )
    return scored.withColumn("is_sampled", (unit_hash(F.col("id"), seed) < chance).cast("int"))


def normalize(logs: DataFrame) -> DataFrame:
    """The columns kept of a log, plus the sampling mark."""
    return logs.select(
        "id", "log_ts", "user_prompt", "model_response", "latency_ms", "user_feedback", "is_sampled"
    )


def ingest(raw: DataFrame, known_ids: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """New logs, redacted, sampled and normalized."""
    return normalize(redact(mark_sampled(with_priority(new_logs(raw, known_ids)), fraction, seed)))


def with_token_estimates(logs: DataFrame) -> DataFrame:
    return logs.withColumns(
        {
            "prompt_tokens": token_estimate(F.col("user_prompt")),
            "completion_tokens": token_estimate(F.col("model_response")),
        }
    )
