import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from goldsieve.llm import simhash
from goldsieve.llm.graph import components
from goldsieve.llm.simhash import block_masks, fingerprint, keep_one_of_each, near_duplicates, print_links
from tests.llm.conftest import EDGE


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B c", "A b c d e", "é É ß x y z", "word " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == brute_print(text)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("ein paar wörter hier")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("ein paar wörter hier".encode(), 42)


@pytest.mark.parametrize("count", [10, 1 << 24, 1 << 30])
def test_some_key_is_shared_by_every_close_pair(count):
    masks, random_ = block_masks(count, 4), random.Random(count)
    for _ in range(500):
        flips = sum(1 << b for b in random_.sample(range(64), 4))
        assert any(flips & m % (1 << 64) == 0 for m in masks)


@pytest.mark.parametrize("short", [1, 12])
def test_links_connect_what_close_prints_connect(spark, short, monkeypatch):
    """Balls around centres (large runs), chains and strangers, in both ways of comparing a run."""
    monkeypatch.setattr(simhash, "SHORT", short)
    rnd, prints = random.Random(3), set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(40)}
    at = rnd.getrandbits(64)
    for _ in range(12):
        prints.add(at)
        at ^= sum(1 << b for b in rnd.sample(range(64), 4))
    prints = sorted(prints | {rnd.getrandbits(64) for _ in range(60)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = print_links(spark.createDataFrame([(p,) for p in signed], "print bigint"))
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    names = {r.node: r.label for r in components(links).collect()}
    got = [names.get(p, p) for p in signed]
    want = brute_components(prints)
    assert {(a, b) for a in range(len(got)) for b in range(a) if got[a] == got[b]} == {(a, b) for a in range(len(got)) for b in range(a) if want[a] == want[b]}


def test_long_path_of_links(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edge_cases(edge, clashing, docs):
    got = near_duplicates(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted(
        (False, k, f"{brute_print(t):016x}") for k, t in (r[:2] for r in EDGE) if k is not None
    )
    named = {r.doc_id: r.component_id for r in got}
    assert named[1] == named[2] == named[3] == 1 and named[5] == 4 and named[9] == 9
    assert near_duplicates(clashing).count() == len(EDGE) and near_duplicates(docs([])).count() == 0


def test_one_of_each_stays(edge, clashing, docs):
    kept = keep_one_of_each(edge).collect()
    classes = {r.component for r in near_duplicates(edge).collect()}
    assert len(kept) == len(classes)
    assert {r.doc_id for r in kept} >= {1, 4, 6, 7, 9} and 5 not in {r.doc_id for r in kept}
    assert keep_one_of_each(clashing).columns == clashing.columns
    assert keep_one_of_each(docs([(None, "a b"), (None, "a b"), (None, "z")])).count() == 2
    assert keep_one_of_each(docs([])).count() == 0


def test_hot_group_of_near_copies(docs):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i % 399] + [f"new{i}"] + base[i % 399 + 1:])) for i in range(300)] + [(1000 + i, f"lone {i} text {i * i} with own words {i + 7}") for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    want = brute_components(prints)
    assert got == {rows[i][0]: rows[w][0] for i, w in enumerate(want)}
