import random
import re

import pytest
from pyspark.sql import functions as F

from goldsieve.fixed import EMAIL_MARK, EMAIL_PATTERN, PHONE_MARK, PHONE_PATTERN
from goldsieve.functions.text import or_word, percent_text, redact_pii, token_estimate
from goldsieve.operators import ingest


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail john.doe@example.com now", "mail [REDACTED_EMAIL] now"),
        ("call 555-123-4567.", "call [REDACTED_PHONE]."),
        ("5551234567 and 555.123.4567", "[REDACTED_PHONE] and [REDACTED_PHONE]"),
        ("x5551234567 15551234567", "x5551234567 15551234567"),
        ("é555-123-4567", "é555-123-4567"),
        ("555-123-4567@example.com", "[REDACTED_EMAIL]"),
        ("+1 (743) 555-3824", "+1 (743) 555-3824"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    assert one(spark, text, redact_pii) == want


def test_priority(spark):
    rows = [("thumbs_down", 2000), ("retry", None), (None, 1501), ("thumbs_up", 1500), (None, None)]
    df = ingest.with_priority(spark.createDataFrame(rows, "user_feedback string, latency_ms int"))
    assert [r.priority_score for r in df.collect()] == [7, 5, 3, 1, 1]


def test_text_helpers(spark):
    assert one(spark, "123456789", token_estimate) == 2
    assert one(spark, "", lambda c: or_word(c, "N/A")) == "N/A"
    df = spark.createDataFrame([(1 / 3,), (0.125,), (0.135,), (1.0,)], "r double")
    assert [r.v for r in df.select(percent_text(F.col("r")).alias("v")).collect()] == ["33%", "12%", "14%", "100%"]


def logs(spark, n):
    kinds = F.array(*[F.lit(x) for x in ("thumbs_down", "thumbs_up")])
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), kinds[(F.col("id") % 2).cast("int")].alias("user_feedback"),
        F.when(F.col("id") % 4 < 2, 2000).otherwise(10).alias("latency_ms"),
    )


def test_sampling_rates_follow_the_weights(spark):
    scored = ingest.with_priority(logs(spark, 40_000))
    got = {r.priority_score: r.rate for r in ingest.mark_sampled(scored).groupBy("priority_score").agg(F.avg("is_sampled").alias("rate")).collect()}
    n, total = 20_000, 40_000 * 4  # weights 7, 3, 5, 1 in equal shares
    for weight, rate in got.items():
        assert rate == pytest.approx(1 - (1 - weight / total) ** n, abs=0.012)


def test_sampling_is_repeatable_and_handles_tiny_batches(spark):
    scored = ingest.with_priority(logs(spark, 100))
    first = {r.id for r in ingest.mark_sampled(scored).filter("is_sampled = 1").collect()}
    again = {r.id for r in ingest.mark_sampled(scored.repartition(7)).filter("is_sampled = 1").collect()}
    assert first == again and first
    assert [r.is_sampled for r in ingest.mark_sampled(ingest.with_priority(logs(spark, 1))).collect()] == [0]
    assert ingest.mark_sampled(ingest.with_priority(logs(spark, 0))).count() == 0


def test_new_and_distinct_logs(spark):
    raw = logs(spark, 6).union(logs(spark, 3))
    known = spark.createDataFrame([("1",), ("5",)], "id string")
    kept = ingest.distinct_logs(ingest.new_logs(raw, known))
    assert sorted(r.id for r in kept.collect()) == ["0", "2", "3", "4"]


def test_redaction_equals_a_direct_reading_of_the_patterns(spark):
    rng = random.Random(9)
    alphabet = "5551234567890--..@ab.com _é%+\n  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [t + rng.choice(["555-123-4567", "555.1234567", "me@x.org"]) + u for t, u in zip(texts, texts[1:])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in df.select("i", redact_pii(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == re.sub(PHONE_PATTERN, PHONE_MARK, re.sub(EMAIL_PATTERN, EMAIL_MARK, t)), t


def test_known_ids_are_taken_out_before_texts_come_in(spark):
    """The anti join runs on the narrow side, below the join that brings the texts and what is made of them."""
    rows = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (None, 10)], "n long, of long")
    texts = spark.createDataFrame([(10, "a"), (11, "b")], "of long, text string")
    wide = rows.join(texts, "of").select(F.col("n").cast("string").alias("id"), F.concat("text", F.lit("!")).alias("user_prompt"))
    known = spark.createDataFrame([("1",), ("1",), (None,)], "id string")
    left = ingest.new_logs(wide, known)
    assert sorted((r.id or "", r.user_prompt) for r in left.collect()) == [("", "a!"), ("2", "a!"), ("2", "b!")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Inner") < plan.index("LeftAnti")


def test_interactions_of_repeated_and_missing_keys(spark, tmp_path):
    """The form that Spark builds gives the rows of the shared SQL."""
    from collections import Counter

    from goldsieve.sources.views import VIEWS, Inputs

    rows = [(0, "a"), (0, "b"), (7, "c"), (None, "d"), (2, None), (1, "e"), (5, "f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    inputs = Inputs(spark, str(tmp_path))
    want = spark.sql(VIEWS["interactions"].replace("documents", "{documents}"), documents=inputs.documents)
    got = Counter(tuple(r) for r in inputs.interactions.collect())
    assert got == Counter(tuple(r) for r in want.collect()) and sum(got.values()) > 4
