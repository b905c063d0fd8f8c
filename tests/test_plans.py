"""Stages over stored tables, the stream, and the registered queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from goldsieve.operators import ingest
from goldsieve.plans.curation import Models, add_notes, fill_gaps, ingest_batch, label_batch, review, run_curation
from goldsieve.plans.evaluation import choose_runs, run_comparison, run_evaluation
from goldsieve.schemas import schema_of
from goldsieve.sources.tables import Tables
from goldsieve.sources.views import Inputs
from goldsieve.streaming.ingest import log_stream, once_within, redacted, start_ingest


def fixed(answer):
    def make():
        return lambda texts: [answer(t) for t in texts]

    return make


def models():
    return Models(
        labeler=fixed(lambda t: json.dumps({"category": "Refusal" if len(t) % 2 else "Normal", "quality_score": len(t) % 5 + 1})),
        golden=fixed(lambda t: json.dumps({"golden_answer": "g", "rubric": {"5": "five"}}) if len(t) % 3 else None),
        multi=fixed(lambda t: json.dumps({"must_contain": ["a"], "must_not_contain": ["zzz"]})),
        voter=fixed(lambda t: json.dumps({"category": "Normal"}) if len(t) % 4 else None),
        label_source="test",
    )


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    tables = Tables(spark, str(tmp_path_factory.mktemp("tables")))
    raw = Inputs(spark, "/root/testdata/sf0.001").raw_logs
    run_curation(tables, raw.filter("log_ts < '2024-01-08'"), models(), "b1")
    return tables, raw


def test_stages_fill_every_table(curated):
    tables, raw = curated
    logs, evals = tables.read("normalized_logs"), tables.read("eval_dataset")
    assert logs.count() == raw.filter("log_ts < '2024-01-08'").count()
    sampled = logs.filter("is_sampled = 1").count()
    assert tables.read("cluster_assignments").count() == sampled > 0
    assert evals.count() == evals.select("eval_id").distinct().count() > 0
    assert tables.read("multi_labels").count() == evals.count() == tables.scores().count()
    assert 0 < tables.read("golden_answers").count() < evals.count()
    needs = tables.scores().filter("status = 'needs_review'").count()
    assert tables.queue().filter("reviewed = 0").count() == needs > 0
    approved = tables.scores().filter("status = 'approved'").count()
    assert tables.read("dedup_log").count() == approved > 0
    assert tables.read("coverage_report").agg(F.sum("count")).first()[0] == tables.read("dedup_log").filter("action = 'accepted'").count()


def test_running_a_batch_again_changes_nothing(curated):
    tables, raw = curated
    before = {t: tables.read(t).count() for t in ("normalized_logs", "eval_dataset", "confidence_scores", "dedup_log", "multi_labels")}
    run_curation(tables, raw.filter("log_ts < '2024-01-08'"), models(), "b1")
    assert before == {t: tables.read(t).count() for t in before}


def test_review_notes_and_gaps(curated):
    tables, _ = curated
    two = [r.eval_id for r in tables.queue().filter("reviewed = 0").orderBy("eval_id").limit(2).collect()]
    spark = tables.spark
    review(tables, spark.createDataFrame([(two[0], "approve"), (two[1], "reject")], "eval_id bigint, decision string"))
    status = {r.eval_id: r.status for r in tables.scores().filter(F.col("eval_id").isin(two)).collect()}
    assert status == {two[0]: "approved", two[1]: "rejected"}
    assert tables.queue().filter(F.col("eval_id").isin(two)).agg(F.min("reviewed")).first()[0] == 1
    add_notes(tables, spark.createDataFrame([(two[0], "old")], "eval_id bigint, manual_notes string"))
    add_notes(tables, spark.createDataFrame([(two[0], "new")], "eval_id bigint, manual_notes string"))
    assert tables.evals().filter(F.col("eval_id") == two[0]).first().manual_notes == "new"
    done = tables.read("eval_dataset").select(F.col("interaction_id").alias("id"))
    pool = tables.read("normalized_logs").select("id").join(done, "id", "left_anti").withColumn("category", F.lit("Jailbreak"))
    picked = fill_gaps(tables, pool)
    assert picked.count() == min(10, pool.count()) > 0
    before = tables.read("eval_dataset").count()
    label_batch(tables, models(), picked)
    assert tables.read("eval_dataset").count() == before + 10


def test_evaluation_and_comparison(curated):
    tables, _ = curated
    good = fixed(lambda t: json.dumps({"score": 5, "passed": True, "must_contain_pass": True}))
    poor = fixed(lambda t: json.dumps({"score": 2}))
    answer = fixed(lambda t: "a " + t)
    old = run_evaluation(tables, answer, good, "m1", run_id="run_1")
    new = run_evaluation(tables, answer, poor, "m2", run_id="run_2", assertions="judge")
    runs = {r.run_id: r for r in tables.runs().collect()}
    total = runs[old].total_cases
    assert total > 0 and runs[old].pass_rate > 0 and runs[new].pass_rate == 0.0
    assert runs[new].failed == total and runs[new].completed_at is not None and runs[new].model_name == "m2"
    with pytest.raises(ValueError):
        run_evaluation(tables, answer, poor, "m2", run_id="run_2")
    assert choose_runs(tables.runs()) == ("run_2", "run_1")
    assert choose_runs(tables.runs(), new="run_1") == ("run_1", "run_2")
    report = run_comparison(tables)
    assert report["regressions"].count() == runs[old].passed
    assert report["coverage"].first().shared == total
    saved = tables.read("regression_reports").first()
    assert (saved.run_id_new, saved.run_id_old, saved.new_failures) == ("run_2", "run_1", runs[old].passed)
    limited = run_evaluation(tables, answer, good, "m1", run_id="run_3", limit=3)
    assert tables.read("eval_results").filter(F.col("run_id") == limited).count() == 3


def test_nothing_to_evaluate_or_compare(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert run_evaluation(tables, fixed(str), fixed(str), "m") is None
    assert run_comparison(tables) is None


def test_tables_read_empty_append_and_replace(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.read("golden_answers").count() == 0 and not tables.exists("golden_answers")
    tables.ensure("golden_answers")
    assert tables.exists("golden_answers")
    tables.append("golden_answers", spark.createDataFrame([(1, "g")], "eval_id bigint, golden_answer string"))
    row = tables.read("golden_answers").first()
    assert row.golden_answer == "g" and row.created_at is not None and row.question_type is None
    report = "category string, difficulty string, count bigint, avg_confidence double"
    tables.replace("coverage_report", spark.createDataFrame([("a", "b", 1, 1.0)], report))
    tables.replace("coverage_report", spark.createDataFrame([], report))
    assert tables.read("coverage_report").count() == 0


def arrivals(spark, folder):
    """Two files of raw logs; the second repeats some ids of the first."""
    rows = [
        (str(i), f"2024-01-01T00:00:{i:02d}", f"ask {i} a{i}@b.org" if i % 3 == 0 else f"ask {i}", "thumbs_down" if i % 2 else None)
        for i in range(40)
    ]
    frame = spark.createDataFrame(rows, "id string, ts string, user_prompt string, user_feedback string").select(
        "id", F.col("ts").cast("timestamp").alias("log_ts"), "user_prompt", "user_feedback"
    )
    whole = frame
    for field in schema_of("raw_logs").fields:
        if field.name not in whole.columns:
            whole = whole.withColumn(field.name, F.lit(None).cast(field.dataType))
    whole = whole.select(*schema_of("raw_logs").names)
    whole.filter("cast(id as int) < 30").coalesce(1).write.mode("append").parquet(folder)
    whole.filter("cast(id as int) >= 20").coalesce(1).write.mode("append").parquet(folder)
    return whole


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    whole = arrivals(spark, str(tmp_path / "in"))
    tables = Tables(spark, str(tmp_path / "t"))
    stream = log_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    start_ingest(stream, tables, str(tmp_path / "cp")).awaitTermination()
    got = tables.read("normalized_logs")
    want = ingest.redact(whole)
    columns = ["id", "user_prompt", "user_feedback"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert got.select("ingest_batch").distinct().count() == 2
    # the same files again, under a fresh checkpoint and another name: every id is known
    for n, keep in enumerate((False, True)):
        again = log_stream(spark, str(tmp_path / "in"))
        start_ingest(again, tables, str(tmp_path / f"again{n}"), name=f"again{n}", ids_keep_time=keep).awaitTermination()
        assert tables.read("normalized_logs").count() == 40


def test_batch_rerun_replaces_its_own_rows(spark, tmp_path):
    whole = arrivals(spark, str(tmp_path / "in"))
    tables = Tables(spark, str(tmp_path / "t"))
    for _ in range(2):
        ingest_batch(tables, whole, "b")
        assert tables.read("normalized_logs").count() == 40


def test_once_within_drops_repeats_in_the_stream(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"))
    stream = redacted(once_within(log_stream(spark, str(tmp_path / "in"), files_per_batch=1), "1 hour"))
    query = stream.select("id", "user_prompt", "priority_score").writeStream.format("memory").queryName("seen").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("seen")
    assert got.count() == 40 and got.filter("user_prompt like '%REDACTED_EMAIL%'").count() == 14


@pytest.fixture(scope="module")
def con(small):
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_registered_query(spark, small, con, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check import canonical

    got = contract.queries()[name](spark, small).toArrow()
    assert got.num_rows > 0
    oracle = contract.oracle_sql().get(name)
    if oracle:
        want = con.sql(oracle).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
