import pytest
from pyspark.sql import functions as F

from goldsieve.operators import coverage, curate, evaluate, pending, regress, upkeep


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gaps_keep_both_thresholds_and_absent_categories(spark):
    report = spark.createDataFrame([("Normal", "simple", 5, 1.0), ("Normal", "hard", 4, 1.0), ("Refusal", "simple", 2, 1.0)],
                                   "category string, difficulty string, count bigint, avg_confidence double")
    assert [r.needs_more for r in coverage.flag_thin(report).collect()] == [False, False, True]
    gaps = coverage.coverage_gaps(report)
    assert rows(coverage.gap_quota(gaps)) == [
        ("Angry User", "simple", 0, 5, 10), ("Hallucination", "simple", 0, 5, 10), ("Jailbreak", "simple", 0, 5, 10),
        ("Normal", "hard", 4, 1, 2), ("Policy Question", "simple", 0, 5, 10), ("Refusal", "simple", 2, 3, 6),
    ]
    empty = report.limit(0)
    assert coverage.coverage_gaps(empty).count() == 6


def test_top_up_ranks_the_same_with_any_number_of_slices(spark):
    pool = spark.range(900).select(
        F.col("id").cast("string"), F.when(F.col("id") < 600, "Normal").when(F.col("id") < 603, "Refusal").otherwise("x").alias("category")
    )
    quotas = spark.createDataFrame([("Normal", 10), ("Normal", 7), ("Refusal", 6)], "category string, quota bigint")
    picked = [rows(coverage.top_up(quotas, pool, salts=s)) for s in (1, 64)]
    assert picked[0] == picked[1]
    assert len([r for r in picked[0] if "Normal" in r]) == 17 and len([r for r in picked[0] if "Refusal" in r]) == 3


def test_accepted_or_unchecked(spark):
    evals = spark.createDataFrame([(1,), (2,), (3,)], "eval_id bigint")
    log = spark.createDataFrame([(1, "accepted"), (2, "rejected_duplicate")], "candidate_eval_id bigint, action string")
    assert rows(coverage.accepted_or_unchecked(evals, log)) == [(1,), (3,)]


def test_assertions_and_pass_rule(spark):
    df = spark.createDataFrame(
        [(1, "Hello World", '["hello"]', '["bad"]', 4), (2, "Hello", '["hello","x"]', None, 5), (3, "bad", "[]", '["BAD"]', 5),
         (4, None, None, "", 5), (5, "ok", None, None, 3), (6, "ok", None, None, None)],
        "eval_id int, model_response string, must_contain string, must_not_contain string, score int",
    )
    got = evaluate.apply_pass_rule(evaluate.check_assertions(df))
    assert rows(got.select("eval_id", "must_contain_pass", "must_not_contain_pass", "passed")) == [
        (1, True, True, True), (2, False, True, False), (3, True, False, False), (4, True, True, True),
        (5, True, True, False), (6, True, True, False),
    ]


def test_summary_and_breakdown(spark):
    df = spark.createDataFrame([("r", "A", "s", True), ("r", "A", "s", False), ("r", None, "s", True)],
                               "run_id string, category string, difficulty string, passed boolean")
    assert rows(evaluate.run_summary(df)) == [("r", 3, 2, 1, 2 / 3)]
    assert rows(evaluate.breakdown(df)) == [("r", "A", "s", 1, 2, 0.5)]


RESULT = "run_id string, eval_case_id int, category string, difficulty string, score int, passed int, reasoning string"


def results(spark):
    data = [
        ("n", 1, "A", "s", 2, 0, "x" * 100), ("o", 1, "A", "s", 5, 1, ""), ("n", 2, "A", "s", 5, 1, ""), ("o", 2, "A", "s", 1, 0, ""),
        ("n", 3, "A", "s", 3, 0, ""), ("o", 3, "A", "s", 2, 0, ""), ("n", 4, "A", "s", 3, 0, ""), ("o", 4, "A", "s", 1, 0, ""),
        ("n", 5, "A", "s", 3, 0, ""), ("o", 6, "B", "s", 3, 0, ""), ("z", 7, "C", "s", 1, 1, ""), ("n", 8, "D", "s", 1, 0, ""),
        ("n", 9, "A", "s", 1, 0, ""), ("o", 9, "A", "s", 5, 0, ""),
    ]
    return spark.createDataFrame(data, RESULT)


def test_transitions_are_exclusive_and_complete(spark):
    compared = regress.compare(results(spark), "n", "o")
    got = regress.transitions(compared)
    assert {r.eval_case_id: r.transition for r in got.collect()} == {
        1: "regression", 2: "improvement", 3: "unchanged", 4: "score_shift", 9: "score_shift",
    }
    assert rows(regress.run_coverage(compared)) == [(5, 2, 1)]
    assert rows(regress.regressions(got)) == [(1, "A", "s", 5, 2, "x" * 80)]
    assert {r.eval_case_id: r.direction for r in regress.score_shifts(got).collect()} == {4: "up", 9: "DOWN"}
    assert rows(regress.regression_summary(got, "n", "o")) == [("n", "o", 1, 1, 2)]


def test_category_shift_is_strict_and_needs_both_runs(spark):
    rates = spark.createDataFrame(
        [("a", 1.0, 0.9), ("b", 1.0, 0.8), ("c", 0.1, 0.9), ("d", None, 0.9), (None, 0.0, 1.0)],
        "category string, old_rate double, new_rate double",
    )
    got = [(r.category, r.flag) for r in regress.category_shift(rates).collect()]
    assert got == [("a", ""), ("b", "WARNING"), ("c", "IMPROVED")]  # 0.9 - 1.0 is just above -0.1
    assert rows(regress.category_rates(results(spark), "n", "o"))[0][0] in ("A", "B", "D")
    assert rows(regress.all_categories(regress.results_of(results(spark), "n"), regress.results_of(results(spark), "o"))) == [
        ("A",), ("B",), ("D",)]


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(upkeep.upsert(old, new, "k").filter("v is not null")) == [(1, "a"), (3, "c")]
    assert rows(upkeep.insert_if_absent(old, new, "k")) == [(1, "a"), (2, "b"), (3, "c")]
    assert {r.k: r.v for r in upkeep.keyed_update(old, new, "k").collect()} == {1: "a", 2: None}
    wide = upkeep.add_missing_column(upkeep.add_missing_column(old, "n", "string"), "n", "string")
    assert wide.columns == ["k", "v", "n"]
    history = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, at int, v string")
    assert rows(upkeep.latest_per_key(history, "k", "at")) == [(1, 2, "y"), (2, 1, "z")]
    ids = upkeep.assign_eval_ids(spark.range(2000).select(F.col("id").cast("string").alias("interaction_id")))
    assert ids.select("eval_id").distinct().count() == 2000 and ids.filter("eval_id < 0").count() == 0


def test_pending_keeps_unsampled_negative_feedback(spark):
    logs = spark.createDataFrame(
        [("1", None, "thumbs_down", 0), ("2", -1, None, 1), ("3", 4, None, 1), ("4", None, None, 1), ("5", -1, "retry", 1)],
        "id string, cluster_id int, user_feedback string, is_sampled int",
    ).withColumns({"user_prompt": F.lit("p"), "model_response": F.lit("r")})
    done = spark.createDataFrame([("5",)], "interaction_id string")
    assert [r.id for r in pending.to_label(logs, done).orderBy("id").collect()] == ["1", "2"]
    assert [r.id for r in pending.to_cluster(logs).collect()] == ["4"]


def test_review_views(spark):
    view = spark.createDataFrame(
        [(1, "approved", "A", "hard", 4, None, "", '["a","b"]', None), (2, "rejected", "B", "hard", 2, "g", "r", None, "[]"),
         (3, None, "A", "simple", 5, "g", "r", None, None)],
        "eval_id int, status string, category string, difficulty string, quality_score int, golden_answer string, "
        "rubric_score_5 string, must_contain string, must_not_contain string",
    )
    assert [r.eval_id for r in curate.filter_explorer(view).collect()] == [1]
    assert curate.filter_explorer(view, min_quality=5).count() == 0
    assert curate.filter_explorer(view, status=None, categories=["A"], difficulties=[]).count() == 2
    text = curate.assertion_text(view).orderBy("eval_id").first()
    assert (text.must_contain_text, text.must_not_contain_text, text.golden_text, text.rubric_text) == ("a, b", "None", "N/A", "N/A")
    matrix = curate.coverage_matrix(view).orderBy("category").collect()
    assert [tuple(r) for r in matrix] == [("A", 1, 0, 1, 0), ("B", 0, 0, 1, 0)]
    assert rows(curate.curation_kpis(view.select("eval_id"), view.select("eval_id", "status"))) == [(3, 1, 1)]


def test_one_row_per_eval(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, None, "z")], "eval_id int, g string, r string")
    assert rows(evaluate.one_per_eval(df, "g", "r")) == [(1, "a", "y"), (2, None, "z")]


@pytest.mark.parametrize("limit,want", [(None, 3), (0, 3), (2, 2)])
def test_first_cases(spark, limit, want):
    df = spark.createDataFrame([(3,), (1,), (2,)], "eval_id int")
    got = [r.eval_id for r in evaluate.first_cases(df, limit).collect()]
    assert len(got) == want and (want == 3 or got == [1, 2])
