"""Checkpoints as the state of a loop."""

import os

from goldsieve.session import cut_lineage, release


def test_a_state_joined_with_itself_keeps_a_bounded_size_estimate(spark):
    state = spark.range(1000).selectExpr("id", "id % 10 AS up").groupBy("id").agg({"up": "max"}).toDF("id", "up")
    for _ in range(8):
        above = state.selectExpr("id AS up", "up AS upper")
        state = cut_lineage(state.join(above, "up").selectExpr("id", "upper AS up"))
        assert state._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() <= 63  # 2,000 bits and more unless cut
    assert state.schema.simpleString() == "struct<id:bigint,up:bigint>"
    assert {(r.id, r.up) for r in state.collect()} == {(i, i % 10) for i in range(1000)}


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_shuffle_files_go_with_the_checkpoint_and_a_released_state_goes_at_once(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(b.name().startswith("shuffle_") for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()))
    frame = spark.range(20_000).selectExpr("id", "id % 777 AS k").groupBy("k").count()
    before, kept = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    stored = cut_lineage(frame)
    assert shuffles() <= before
    assert stored.count() == 777 and frame.count() == 777  # what led to it can still be worked out
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    next_state = cut_lineage(stored.filter("k < 10"))
    whole = _bytes(folder)
    release(stored)
    assert _bytes(folder) < whole and next_state.count() == 10
