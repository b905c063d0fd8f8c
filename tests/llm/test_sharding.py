from collections import defaultdict

import pytest

from goldsieve.llm.sharding import shard_by_bytes, splitters
from tests.llm.conftest import EDGE


def check(rows, got, shards):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard_bytes == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def loads(got, shards):
    out = [0] * shards
    for r in got:
        out[r.shard] += r.shard_bytes
    return out


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_edge_cases(edge, shards):
    check(EDGE, shard_by_bytes(edge, shards).collect(), shards)


def test_near_equal_and_groups_together(docs):
    rows = [(i, f"document {i} " + "x" * (i * 37 % 900)) for i in range(4000)] + [(10_000 + i, "copy " * 40) for i in range(300)]
    got = shard_by_bytes(docs(rows), 16).collect()
    check(rows, got, 16)
    out = loads(got, 16)
    assert max(out) - min(out) < 0.02 * sum(out) / 16
    assert len({r.shard for r in got if r.text == "copy " * 40}) == 1
    again = shard_by_bytes(docs(rows), 16).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}


def test_group_larger_than_a_shard_is_split(docs):
    rows = [(i, "same text in a third of all rows" if i % 3 == 0 else f"text number {i} of the table here") for i in range(6000)]
    got = shard_by_bytes(docs(rows), 8).collect()
    check(rows, got, 8)
    out = loads(got, 8)
    assert max(out) - min(out) < 0.05 * sum(out) / 8


def test_splitters_count_exact_bytes(spark):
    light = spark.createDataFrame([(i << 40, 10) for i in range(1000)], "key bigint, size bigint")
    found = splitters(light, [2500.0, 5000.0, 7500.0], 20)
    assert [abs(10 * sum((i << 40) < b for i in range(1000)) - t) <= 20 for b, t in zip(found, [2500, 5000, 7500])] == [True] * 3


def test_clashing_and_empty(clashing, docs):
    got = shard_by_bytes(clashing, 4)
    assert {"row", "place", "key", "size", "slice"} <= set(got.columns) and got.columns.count("shard") == 1
    check(EDGE, got.collect(), 4)
    assert shard_by_bytes(docs([]), 4).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()
