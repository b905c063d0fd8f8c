"""Evaluating a model on the curated set and comparing two runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.fixed import MODEL_ERROR
from goldsieve.operators import evaluate, judge, regress
from goldsieve.plans.curation import Maker
from goldsieve.session import cut_lineage
from goldsieve.sources.tables import Tables


def run_evaluation(
    tables: Tables, model: Maker, scorer: Maker, model_name: str, model_type: str = "injected",
    run_id: str | None = None, limit: int | None = None, assertions: str = "literal", partitions: int | None = None,
    verdict: str = "rule", system_prompt: str | None = None,
) -> str | None:
    """Ask the model, score its answers, store results and the run's summary.

    Returns the run id, or None when there is no case to evaluate.

    ``assertions`` is 'literal' (texts contained or not) or 'judge' (the scorer's own two flags); ``verdict`` is 'rule' or 'judge'
    (the scorer's own pass flag). The model gets ``system_prompt``, when there is one, and a blank line before each prompt.
    """
    run_id = run_id or f"run_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    if not tables.read("eval_runs").filter((F.col("run_id") == run_id) & F.col("completed_at").isNotNull()).isEmpty():
        raise ValueError(f"run {run_id} is complete; results are stored once per run")
    cases = evaluate.eval_cases(
        tables.read("eval_dataset"), tables.read("normalized_logs"), tables.scores(),
        evaluate.one_per_eval(tables.read("golden_answers"), "golden_answer", "rubric_score_5"),
        evaluate.one_per_eval(tables.read("multi_labels"), "must_contain", "must_not_contain", "expected_behavior"),
        tables.read("dedup_log"),
    )
    cases = cut_lineage(evaluate.first_cases(cases, limit))
    total = cases.count()
    if not total:
        return None
    spark = tables.spark
    start = spark.createDataFrame([(run_id, model_name, model_type, total)], "run_id string, model_name string, model_type string, total_cases bigint")
    start = start.withColumn("started_at", F.current_timestamp())
    start = cut_lineage(start)
    tables.append("eval_runs", start)

    tasks = partitions or judge.tasks_for(cases)
    prompt = F.col("user_prompt") if system_prompt is None else F.concat(F.lit(system_prompt + "\n\n"), "user_prompt")
    put = cases.withColumn("_prompt", prompt)
    answered = cut_lineage(judge.infer(put, "_prompt", "model_response", model, tasks, MODEL_ERROR).drop("_prompt"))
    message = judge.score_message(
        F.col("user_prompt"), judge.reference_text(F.col("golden_answer"), F.col("rubric_score_5")),
        F.col("model_response"), F.col("must_contain"), F.col("must_not_contain"), F.col("expected_behavior"),
    )
    asked = answered.withColumn("message", message).drop("user_prompt", "golden_answer", "rubric_score_5")
    raw = cut_lineage(judge.infer(asked, "message", "raw", scorer, tasks, error="error").drop("message"))
    scored = judge.normalize_score(raw, error="error").drop("error")
    if assertions == "literal":
        scored = evaluate.check_assertions(scored)
    results = evaluate.apply_pass_rule(scored, verdict=verdict).withColumn("eval_case_id", F.col("eval_id"))
    tables.put_part("eval_results", results, run_id)

    summary = evaluate.run_summary(regress.results_of(tables.read("eval_results"), run_id))
    done = start.drop("total_cases").join(summary, "run_id").withColumn("completed_at", F.current_timestamp())
    tables.append("eval_runs", done)
    return run_id


def choose_runs(runs: DataFrame, new: str | None = None, old: str | None = None) -> tuple[str, str] | None:
    """The runs to compare: given ids are kept, missing ones are the latest completed others."""
    if new and old:
        return new, old
    others = runs.filter(~F.col("run_id").isin([r for r in (new, old) if r] or [""]))
    latest = [r.run_id for r in regress.latest_two(others).collect()]  # two rows at most
    picked = iter(latest)
    pair = new or next(picked, None), old or next(picked, None)
    return pair if all(pair) else None


def run_comparison(tables: Tables, new: str | None = None, old: str | None = None) -> dict[str, DataFrame] | None:
    """Compare two runs and store the report row; None when there are no two runs."""
    pair = choose_runs(tables.runs(), new, old)
    if pair is None:
        return None
    results = tables.read("eval_results")
    if not regress.repeated_cases(results.filter(F.col("run_id").isin(*pair))).isEmpty():
        raise ValueError("a run holds a case more than once")
    compared = regress.compare(results, *pair)
    changes = cut_lineage(regress.transitions(compared))
    summary = regress.regression_summary(changes, *pair)
    tables.append("regression_reports", summary)
    return {
        "coverage": regress.run_coverage(compared),
        "regressions": regress.regressions(changes),
        "improvements": regress.improvements(changes),
        "score_shifts": regress.score_shifts(changes),
        "category_shift": regress.category_shift(regress.category_rates(results, *pair)),
        "summary": summary,
    }
