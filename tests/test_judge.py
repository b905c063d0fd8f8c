import json
import random

from pyspark.sql import functions as F

from goldsieve.operators import confidence, judge


def raw(spark, *values):
    texts = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame(list(enumerate(texts)), "eval_id int, raw string").coalesce(1)


def by_id(df):
    return {r.eval_id: r for r in df.collect()}


def test_truthiness_follows_the_json_type(spark):
    got = by_id(judge.normalize_label(raw(
        spark, {"category": "0", "quality_score": 0}, {"category": 0, "Category": "B", "quality_score": "4"},
        {"category": [], "Category": {}, "interaction_type": "C"}, {"category": False, "quality_score": 0.0, "quality": 2},
        {"category": None},
    )))
    assert [got[i].category for i in range(5)] == ["0", "B", "C", "Unknown", "Unknown"]
    assert [got[i].quality_score for i in range(5)] == [3, 4, 3, 2, 3]


def test_failed_labels_are_kept_as_fallback(spark):
    got = by_id(judge.label_with_fallback(raw(spark, None, "nope", [1], {}, {"quality_score": 4}), source=F.lit("m")))
    assert [got[i].labeled_by for i in range(5)] == ["fallback", "fallback", "fallback", "m", "m"]
    assert got[0].reasoning == "OpenRouter failed (openrouter_exhausted)"
    assert got[1].reasoning == "OpenRouter failed (parse_error)"
    assert (got[0].category, got[0].difficulty, got[0].quality_score) == ("Labeling Failed", "unknown", 3)
    assert [got[i].is_positive_case for i in range(5)] == [0, 0, 0, 0, 1]
    assert got[3].category == "Unknown"


def test_the_last_of_a_repeated_key_counts(spark):
    assert judge.normalize_label(raw(spark, '{"category":"A","category":"B"}')).first().category == "B"


def test_source_is_taken_from_the_model_name(spark):
    df = spark.createDataFrame([("vendor/name-1:free",)], "m string")
    assert df.select(judge.model_source(F.col("m")).alias("s")).first().s == "openrouter:name-1"


def test_rubric_shapes(spark):
    got = by_id(judge.normalize_rubric(raw(
        spark, {"rubric": {"score_5": "a", "3": "b", "poor": "c"}}, {"rubric": '{"5": "x"}'}, {"rubric": "plain"},
        {"rubric": "[1]"}, {"rubric": [], "scoring_rubric": {"excellent": "e"}}, {"answer": "w"}, {}, "broken{",
    )))
    levels = {i: (r.rubric_score_5, r.rubric_score_3, r.rubric_score_1) for i, r in got.items()}
    assert levels == {
        0: ("a", "b", "c"), 1: ("x", "", ""), 2: ("plain", "", ""), 3: ("", "", ""), 4: ("e", "", ""), 5: ("", "", ""),
    }


def test_golden_rows_skip_failures_and_join_both_parts(spark):
    got = by_id(judge.golden_rows(raw(spark, {"answer": "w", "rubric": "p"}, {}, None, "x")))
    assert list(got) == [0]
    assert (got[0].question_type, got[0].golden_answer, got[0].chain_of_thought, got[0].rubric_score_5) == ("unknown", "w", "", "p")


def test_multilabel_defaults(spark):
    got = by_id(judge.normalize_multilabel(raw(spark, {}, {"expected_quality": 5, "must_contain": ["a", "é"]}, None)))
    assert set(got) == {0, 1}
    assert (got[0].expected_quality, got[0].expected_behavior, got[0].must_contain) == (3, "should_answer", "[]")
    assert json.loads(got[1].must_contain) == ["a", "é"]


def test_scores_read_booleans_as_typed(spark):
    got = by_id(judge.normalize_score(raw(
        spark, {"score": "5", "passed": "false", "must_contain_pass": "true"}, {}, None,
        {"score": 0, "must_not_contain_pass": None, "passed": 1},
    )))
    flags = {i: (r.score, r.judge_passed, r.must_contain_pass, r.must_not_contain_pass) for i, r in got.items()}
    assert flags == {
        0: (5, False, True, True), 1: (3, False, False, True), 2: (3, False, False, False), 3: (3, True, False, False),
    }


def test_inference_loads_once_per_task_and_contains_errors(spark):
    def make():
        def ask(texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("down")
            return [t.upper() for t in texts]

        return ask

    df = spark.createDataFrame([("a",), ("boom",)], "t string").coalesce(1)
    got = {r.t: r.o for r in judge.infer(df, "t", "o", make, error_prefix="MODEL ERROR").collect()}
    assert got == {"boom": "[MODEL ERROR: down]", "a": "A"}
    failed = judge.infer(spark.createDataFrame([("boom",)], "t string"), "t", "o", make).first()
    assert failed.o is None


def test_messages_spell_missing_texts(spark):
    df = spark.createDataFrame([(None, "r", '["a","b"]')], "p string, r string, m string")
    got = df.select(
        judge.label_message(F.col("p"), F.col("r")).alias("l"),
        judge.score_message(F.col("p"), F.lit("g"), F.col("r"), F.col("m"), F.col("p"), F.col("p")).alias("s"),
    ).first()
    assert got.l == "User: None\nAI: r"
    assert 'Must Contain: ["a", "b"]\nMust NOT Contain: []\nExpected Behavior: None\n' in got.s


def votes(spark, *per_eval):
    rows = [(e, i + 1, *v) for e, vs in enumerate(per_eval) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "eval_id int, run_idx int, category string, behavior string")


def test_majority_ties_failures_and_empty_evals(spark):
    failed = (None, None)
    v = votes(
        spark, [failed] * 3, [("A", "x"), ("A", "y"), failed], [("B", "x"), ("A", "y"), ("C", "y")],
        [("A", None), ("A", None), ("B", None)],
    )
    evals = spark.createDataFrame([(i,) for i in range(5)], "eval_id int")
    got = by_id(confidence.with_status(confidence.majority(v, evals)))
    shape = {i: (r.num_runs, round(r.agreement_ratio, 3), r.majority_category, r.majority_behavior, r.status) for i, r in got.items()}
    assert shape == {
        0: (3, 0.0, "Unknown", "should_answer", "needs_review"), 1: (3, 0.667, "A", "x", "approved"),
        2: (3, 0.333, "B", "y", "needs_review"), 3: (3, 0.667, "A", "should_answer", "approved"),
        4: (0, 0.0, "Unknown", "should_answer", "needs_review"),
    }
    queue = by_id(confidence.review_queue(confidence.with_status(confidence.majority(v))))
    assert queue[2].reason == "Low confidence (33% agreement across 3 runs)"
    assert set(queue) == {0, 2}


def test_decisions_move_scores_and_queue(spark):
    scores = spark.createDataFrame([(1, "needs_review"), (2, "needs_review"), (3, "approved")], "eval_id int, status string")
    queue = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "eval_id int, reviewed int")
    decided = spark.createDataFrame([(1, "approve"), (2, "reject")], "eval_id int, decision string")
    s, q = confidence.apply_decisions(scores, queue, decided)
    assert {r.eval_id: r.status for r in s.collect()} == {1: "approved", 2: "rejected", 3: "approved"}
    assert [r.reviewed for r in q.collect()] == [1, 1, 1]


def python_text(value):
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def test_fallback_chains_equal_python_or(spark):
    rng = random.Random(4)
    values = [None, "", "0", 0, 0.0, False, True, [], {}, "x y", 1, 2.5, ["a"], {"a": 1}, " ", "false"]
    docs = [
        {k: rng.choice(values) for k in ("category", "Category", "interaction_type") if rng.random() < 0.8} for _ in range(600)
    ]
    got = by_id(judge.normalize_label(raw(spark, *docs)))
    for i, d in enumerate(docs):
        want = d.get("category") or d.get("Category") or d.get("interaction_type") or "Unknown"
        assert got[i].category == python_text(want), d
