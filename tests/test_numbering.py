"""Running totals, dense numbers and draws against plain Python, at any number of partitions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from goldsieve.operators import coverage, curate, numbering, upkeep


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    made = [(f"id{i:05d}", rnd.choice([0, 1, 3, 5, 7, 5000 if i % 97 == 0 else 1])) for i in range(1500)]
    rnd.shuffle(made)
    return spark.createDataFrame(made, "id string, weight int").repartition(7).cache()


@pytest.mark.parametrize("partitions", [1, 64])
def test_running_totals_and_dense_ids(spark, rows, partitions):
    plain = sorted((r.id, r.weight) for r in rows.collect())
    want, before = {}, 0
    for key, weight in plain:
        want[key] = before
        before += weight
    totals = numbering.running_totals(rows, F.col("weight"), "id", partitions=partitions)
    assert {r.id: r.before for r in totals.collect()} == want
    first = numbering.dense_ids(rows.filter("id < 'id00700'"), "id", "n", partitions=partitions)
    both = first.unionByName(numbering.dense_ids(rows.filter("id >= 'id00700'"), "id", "n", first, partitions))
    assert [(r.id, r.n) for r in both.orderBy("n").collect()] == [(k, i + 1) for i, (k, _) in enumerate(plain)]


@pytest.mark.parametrize("partitions", [1, 64])
def test_draws_are_exactly_as_many_and_the_same_anywhere(spark, rows, partitions):
    plain = sorted((r.id, r.weight) for r in rows.collect())
    line = [key for key, weight in plain for _ in range(weight)]
    want = Counter()
    for j in range(750):
        u = int(hashlib.md5(f"42:draw{j}".encode()).hexdigest()[:13], 16) / 2**52
        want[line[int(u * len(line))]] += 1
    got = {r.id: r.draws for r in numbering.weighted_draws(rows, "id", "weight", partitions=partitions).collect()}
    assert got == dict(want) and sum(got.values()) == 750


def test_draws_of_nothing(spark, rows):
    assert numbering.weighted_draws(rows.limit(0), "id", "weight").count() == 0
    assert numbering.weighted_draws(rows.filter("weight = 0"), "id", "weight").count() == 0
    assert numbering.running_totals(rows.limit(0), F.col("weight"), "id").count() == 0


def test_a_report_carried_on_equals_one_made_anew(spark):
    rnd = random.Random(1)
    evals = [(i, rnd.choice("AB"), rnd.choice("xyz")) for i in range(200)]
    before = [(i, rnd.choice(["approved", "needs_review", "rejected"]), rnd.choice([None, 0.5, 1.0])) for i in range(200)]
    after = [(i, rnd.choice(["approved", "rejected"]) if i % 3 == 0 else s, a) for i, s, a in before]
    frame = spark.createDataFrame(evals, "eval_id bigint, category string, difficulty string")
    old, new = (spark.createDataFrame(x, "eval_id bigint, status string, agreement_ratio double") for x in (before, after))
    log = spark.createDataFrame([(i, "rejected_duplicate") for i in range(0, 200, 7)], "candidate_eval_id bigint, action string")
    state = coverage.coverage_state(coverage.counted_evals(frame, old, log))
    touched = [x.filter("eval_id % 3 = 0") for x in (frame, old, new)]
    delta = coverage.coverage_delta(coverage.counted_evals(touched[0], touched[1], log), coverage.counted_evals(touched[0], touched[2], log))
    carried = coverage.apply_delta(state, delta)
    values = lambda report: [(r.category, r.difficulty, r["count"], r.avg_confidence and round(r.avg_confidence, 9)) for r in report.collect()]
    assert values(coverage.report_of(carried)) == values(coverage.coverage_report(frame, new, log))
    undone = coverage.coverage_delta(coverage.counted_evals(frame, new, log), coverage.counted_evals(frame, new.limit(0), log))
    assert coverage.apply_delta(carried, undone).count() == 0


def test_crosstab_has_every_value_that_occurs(spark):
    labels = spark.createDataFrame([("A", "simple"), ("A", "unknown"), ("B", "odd"), (None, "x"), ("B", None), ("A", "simple")], "category string, difficulty string")
    got = {(r.category, r.difficulty): r["count"] for r in curate.label_crosstab(labels).collect()}
    assert got == {(c, d): {("A", "simple"): 2, ("A", "unknown"): 1, ("B", "odd"): 1}.get((c, d), 0) for c in "AB" for d in ("simple", "unknown", "odd")}
    assert curate.label_crosstab(labels.limit(0)).count() == 0


def test_of_equally_new_rows_the_same_one_counts(spark):
    history = [("k", 1, "b"), ("k", 2, "a"), ("k", 2, "c"), ("k", 2, "b")]
    for part in (1, 3):
        frame = spark.createDataFrame(history[::-1] if part == 3 else history, "key string, at int, value string").repartition(part)
        assert [r.value for r in upkeep.latest_per_key(frame, "key", "at").collect()] == ["c"]
