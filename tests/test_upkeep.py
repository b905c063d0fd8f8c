import pytest

from pyspark.sql import functions as F

from goldsieve.operators import confidence, evaluate, ingest, judge, upkeep
from goldsieve.plans import curation
from goldsieve.sources.tables import Tables


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_repeated_keys_of_a_change_give_one_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 1), (3, "p", 1), (3, "q", 2)], "k int, v string, at int").repartition(4)
    assert rows(upkeep.upsert(old, new, "k", "at").select("k", "v")) == [(1, "a"), (2, "x"), (3, "q")]
    assert rows(upkeep.insert_if_absent(old, new, "k", "at").select("k", "v")) == [(1, "a"), (2, "b"), (3, "p")]
    assert rows(upkeep.keyed_update(old, new, "k", "at")) == [(1, "a"), (2, "x")]


def test_without_an_order_the_choice_is_still_the_same(spark):
    new = [(2, "x"), (2, "y"), (2, None)]
    for part in (new, new[::-1]):
        frame = spark.createDataFrame(part, "k int, v string").repartition(3)
        assert rows(upkeep.one_per_key(frame, "k")) == [(2, "y")]
    assert rows(upkeep.one_per_key(spark.createDataFrame([(1,), (1,)], "k int"), "k")) == [(1,)]


def test_two_decisions_on_an_eval(spark):
    scores = spark.createDataFrame([(1, "needs_review"), (2, "needs_review")], "eval_id bigint, status string")
    queue = spark.createDataFrame([(1, "r", 0), (2, "r", 0)], "eval_id bigint, reason string, reviewed int")
    decisions = spark.createDataFrame([(1, "reject", 2), (1, "approve", 3)], "eval_id bigint, decision string, at int")
    new_scores, new_queue = confidence.apply_decisions(scores, queue, decisions, "at")
    assert rows(new_scores.select("eval_id", "status")) == [(1, "approved"), (2, "needs_review")]
    assert rows(new_queue.select("eval_id", "reviewed")) == [(1, 1), (2, 0)]


def test_a_batch_that_became_empty_replaces_its_rows(spark, tables):
    row = spark.createDataFrame([("a", "p"), ("b", "p")], "id string, user_prompt string")
    tables.put_part("normalized_logs", row, "one")
    tables.put_part("normalized_logs", row.limit(1), "two")
    tables.put_part("normalized_logs", row.limit(0), "one")
    assert rows(tables.read("normalized_logs").select("ingest_batch")) == [("two",)]
    tables.put_part("normalized_logs", row.limit(0), "never")


def test_among_repeated_ids_the_earliest_stays(spark):
    logs = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("a", 1, "early"), ("b", None, "x")], "id string, log_ts int, user_prompt string")
    for part in (logs, logs.repartition(4)):
        assert rows(ingest.distinct_logs(part)) == [("a", 1, "early"), ("b", None, "x")]


def test_failed_scores_tell_what_failed(spark):
    def broken():
        def ask(texts):
            raise RuntimeError("rate limit reached")
        return ask

    asked = spark.createDataFrame([(1, "m")], "eval_id bigint, message string")
    raw = judge.infer(asked, "message", "raw", broken, error="error").drop("message")
    got = judge.normalize_score(raw, error="error").first()
    assert (got.score, got.judge_passed, got.reasoning) == (3, False, "rate limit reached")
    assert judge.normalize_score(raw.drop("error")).first().reasoning == "No score returned"


def test_the_verdict_of_the_judge_can_decide(spark):
    scored = spark.createDataFrame([(5, False, True, True), (2, True, False, False)], "score int, judge_passed boolean, must_contain_pass boolean, must_not_contain_pass boolean")
    assert [r.passed for r in evaluate.apply_pass_rule(scored).collect()] == [True, False]
    assert [r.passed for r in evaluate.apply_pass_rule(scored, verdict="judge").collect()] == [False, True]
    with pytest.raises(ValueError):
        evaluate.apply_pass_rule(scored, verdict="coin")


def test_each_text_is_encoded_once_over_batches(spark, tables):
    import numpy as np

    calls = spark.sparkContext.accumulator(0)

    def encoder():
        def run(texts):
            calls.add(len(texts))
            return np.random.default_rng().standard_normal((len(texts), 4))  # never the same twice
        return run

    models = curation.Models(None, None, None, None, encoder=encoder, encoder_name="noise", partitions=2)
    for first, last in ((0, 6), (6, 10)):
        ids = range(first, last)
        tables.append("eval_dataset", spark.createDataFrame([(i, str(i)) for i in ids], "eval_id bigint, interaction_id string"))
        tables.put_part("normalized_logs", spark.createDataFrame([(str(i), f"prompt {i}") for i in ids], "id string, user_prompt string"), f"b{first}")
        tables.append("confidence_scores", spark.createDataFrame([(i, "approved") for i in ids], "eval_id bigint, status string"))
        curation.dedup_batch(tables, models)
        assert calls.value == last
    assert rows(tables.read("dedup_log").select("candidate_eval_id")) == [(i,) for i in range(10)]


def test_pending_texts_are_read_from_their_batches_only(spark, tables):
    for batch in ("old", "new"):
        tables.put_part("normalized_logs", spark.createDataFrame([(batch, "p", 1)], "id string, user_prompt string, is_sampled int"), batch)
    tables.append("cluster_assignments", spark.createDataFrame([("old", 1)], "id string, cluster_id bigint"))
    curation.cluster_batch(tables, curation.Models(None, None, None, None), "new")
    assert rows(tables.read("cluster_assignments").select("id")) == [("new",), ("old",)]
    read = tables.with_texts(spark.createDataFrame([("new", "new")], "id string, ingest_batch string"), "user_prompt")
    assert "ingest_batch=new" in "".join(read.inputFiles()) and "ingest_batch=old" not in read.select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert rows(read) == [("new", "p")]


def test_a_stored_table_gains_a_column(spark, tmp_path):
    first, other = Tables(spark, str(tmp_path / "t")), Tables(spark, str(tmp_path / "t"))
    notes = spark.createDataFrame([(1, "a")], "eval_id bigint, manual_notes string")
    first.append("reviewer_notes", notes)
    other.add_column("reviewer_notes", "reviewer", "string")
    other.add_column("reviewer_notes", "reviewer", "string")
    other.add_column("reviewer_notes", "manual_notes", "string")  # declared: nothing to do
    other.append("reviewer_notes", notes.withColumn("eval_id", F.lit(2)).withColumn("reviewer", F.lit("x")))
    again = Tables(spark, str(tmp_path / "t"))
    again.append("reviewer_notes", notes.withColumn("eval_id", F.lit(3)))
    assert {r.eval_id: r.reviewer for r in again.read("reviewer_notes").collect()} == {1: None, 2: "x", 3: None}
    assert again.read("reviewer_notes").columns[-1] == "reviewer" and "reviewer" not in again.read("golden_answers").columns
