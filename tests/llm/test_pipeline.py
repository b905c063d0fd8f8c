import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from goldsieve.llm.common import stored
from goldsieve.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import EDGE


def test_stages_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], small), name))
        assert name == corpus_pipeline.STAGES[-1][0] or seen[-1].columns == columns
    raw, known, lined, single, mixed, last = seen
    assert 0.95 * raw.count() <= known.count() <= raw.count()
    assert lined.join(known, "doc_id", "left_anti").isEmpty() and lined.filter("n_chars <> length(text)").isEmpty()
    assert lined.select(F.explode(F.split("text", "\n")).alias("x")).filter("x rlike '[^ ]'").groupBy("x").count().filter("count > 1").isEmpty()
    assert single.count() == single.select("doc_id").distinct().count() <= lined.count()
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert len(words) > 1 and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert last.count() == mixed.count()
    decoded = {r.doc_id: r.decoded_sha256 for r in last.collect()}
    assert decoded == {r.doc_id: r.h for r in mixed.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}


def test_run_gives_the_rows_of_the_last_stage(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_at_the_edges(spark, small, clashing, docs, name, stage):
    got = stage(spark, clashing, small)
    assert name == "bpe-encode-decode" or got.columns == clashing.columns
    assert 0 < got.count() <= 3 * len(EDGE) or name == "language-id"
    assert stage(spark, docs([]), small).count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
