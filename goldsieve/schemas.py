"""Schemas of the stage tables."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "raw_logs": (
        "id string, log_ts timestamp, user_prompt string, system_prompt string, model_used string, "
        "model_response string, latency_ms int, prompt_tokens int, completion_tokens int, "
        "user_feedback string, feature_name string, pii_redacted int"
    ),
    "normalized_logs": (
        "id string, log_ts timestamp, user_prompt string, model_response string, latency_ms int, "
        "user_feedback string, is_sampled int"
    ),
    "cluster_assignments": ("id string, batch_id string, cluster_id bigint"),
    "eval_dataset": (
        "eval_id bigint, interaction_id string, category string, quality_score int, difficulty string, "
        "is_positive_case int, reasoning string, labeled_by string"
    ),
    "reviewer_notes": ("eval_id bigint, manual_notes string, noted_at timestamp"),
    "golden_answers": (
        "eval_id bigint, question_type string, chain_of_thought string, golden_answer string, "
        "rubric_score_5 string, rubric_score_3 string, rubric_score_1 string, created_at timestamp"
    ),
    "multi_labels": (
        "eval_id bigint, expected_quality int, expected_behavior string, must_contain string, "
        "must_not_contain string, created_at timestamp"
    ),
    "confidence_scores": (
        "eval_id bigint, num_runs int, agreement_ratio double, majority_category string, "
        "majority_behavior string, status string, created_at timestamp"
    ),
    "human_review_queue": ("eval_id bigint, reason string, reviewed int, created_at timestamp"),
    "dedup_log": (
        "candidate_eval_id bigint, duplicate_of_eval_id bigint, similarity_score double, action string, "
        "created_at timestamp"
    ),
    "eval_vectors": (
        "eval_id bigint, encoder string, terms array<bigint>, weights array<double>, norm2 double, fingerprint string, "
        "created_at timestamp"
    ),
    "coverage_report": (
        "category string, difficulty string, count bigint, avg_confidence double, updated_at timestamp"
    ),
    "eval_runs": (
        "run_id string, model_name string, model_type string, started_at timestamp, completed_at timestamp, "
        "total_cases bigint, passed bigint, failed bigint, pass_rate double"
    ),
    "eval_results": (
        "run_id string, eval_case_id bigint, category string, difficulty string, expected_behavior string, "
        "model_response string, score int, passed int, judge_passed int, must_contain_pass int, "
        "must_not_contain_pass int, reasoning string"
    ),
    "regression_reports": (
        "run_id_new string, run_id_old string, new_failures bigint, new_passes bigint, score_shifts bigint, "
        "created_at timestamp"
    ),
}


def schema_of(table: str) -> T.StructType:
    """The declared schema; needs a running session to read the DDL."""
    return T.StructType.fromDDL(TABLES[table])
