"""The index of rare terms, and what uses it, against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from goldsieve.functions.vectors import with_token_vector
from goldsieve.operators import dedup, prefix_index, similarity


def corpus(seed, n):
    """Texts over frequent and rare words, with near copies, a hot group of copies, equal texts and empty ones."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = rnd.choices("a b c d e f".split(), k=rnd.randint(0, 8)) + [f"w{rnd.randrange(40)}" for _ in range(rnd.randint(1, 6))] + [f"u{i}x{k}" for k in range(3)]
        out.append(words)
    for i in range(n // 3):  # a third of all rows resembles one text
        out.append([*out[0], *"p q r s t u v x y z".split(), f"n{i}"])
    for i in range(5):
        out.append(out[i][1:] if len(out[i]) > 9 else out[i])
    out += [out[1], [], [], ["a"], ["a", "a"], ["b", "b", "c", "c"], ["b", "c"]]
    return [" ".join(w) for w in out]


def pool(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "eval_id bigint, text string")
    return with_token_vector(rows, "text").withColumn("ask", F.lit(True)).drop("text")


def above(values, threshold):
    """Neighbours of every text, in whole numbers."""
    counts = [Counter(v.split()) for v in values]
    norms = [sum(c * c for c in x.values()) for x in counts]
    share = round(threshold * 100)

    def near(i, j):
        dot = sum(c * counts[j][t] for t, c in counts[i].items())
        return dot > 0 and dot * dot * 10_000 > share * share * norms[i] * norms[j]

    return [[j for j in range(len(values)) if j != i and near(i, j)] for i in range(len(values))]


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(similarity, "INDEX_FROM", 0)


@pytest.mark.parametrize("threshold", [0.92, 0.5])
def test_searches_by_the_index_equal_all_pairs(spark, always, threshold):
    values = corpus(1, 60)
    near, rows = above(values, threshold), pool(spark, values).cache()
    found = {r.eval_id: r.neighbors for r in dedup.close_neighbors(rows, threshold, block_rows=8).collect()}
    assert found == {i: len(n) for i, n in enumerate(near)}
    kept, first = set(), {}
    for i, n in enumerate(near):
        lower = [j for j in n if j in kept]
        first[i] = min(lower, default=None)
        if not lower:
            kept.add(i)
    got = {r.candidate_eval_id: r.duplicate_of_eval_id for r in dedup.first_wins(rows, threshold, block_rows=8).collect()}
    assert got == first
    label = list(range(len(values)))
    while True:
        new = [min([label[i], *(label[j] for j in n)]) for i, n in enumerate(near)]
        if new == label:
            break
        label = new
    classes = {r.eval_id: (r.class_id, r.links) for r in dedup.duplicate_classes(rows, threshold, block_rows=8).collect()}
    assert classes == {i: (label[i], len(near[i])) for i in range(len(values))}
    best = {r.eval_id: r.match_id for r in dedup.best_match(rows, floor=threshold, block_rows=8).collect()}
    assert {i for i, m in best.items() if m is not None} >= {i for i, n in enumerate(near) if n}
    rows.unpersist()


def test_few_visits_where_words_are_rare(spark, always, monkeypatch):
    """Of texts with words of their own, copies alone have blocks to visit, whatever their number."""
    monkeypatch.setattr(prefix_index, "_SLICE_ROWS", 16)
    shares = []
    for n in (100, 400):
        values = [f"the the of {' '.join(f'w{i}x{k}' for k in range(12))}" for i in range(n)] + [f"the the of {' '.join(f'w{i}x{k}' for k in range(12))} more" for i in range(10)]
        _, groups = dedup._groups(pool(spark, values))
        layout = similarity.lay_out(groups.select(*similarity.VECTOR), block_rows=16)
        found = similarity.near_visits(layout, 0.92)
        shares.append(found.agg(F.sum("pairs")).first()[0] or 0)
    assert max(shares) <= 20


def test_lengths_left_bound_every_pair(spark):
    values = corpus(2, 30)
    _, groups = dedup._groups(pool(spark, values))
    rows = {r.key: r for r in prefix_index.ranked(groups, 0.8).collect()}
    df = Counter(t for r in rows.values() for t in r.terms)
    for r in rows.values():
        order = list(zip(r.dfs, r.terms))
        assert order == sorted(order) and r.dfs == [df[t] for t in r.terms]
        assert sum(w * w for w in r.weights) == pytest.approx(1)
        left = [math.sqrt(sum(w * w for w in r.weights[i:])) for i in range(len(r.weights) + 1)]
        size = len(r.left)
        assert r.left == pytest.approx(left[:size], abs=1e-6) and r.rest == pytest.approx(left[size], abs=1e-6)
        assert r.rest <= 0.8 and all(x > 0.7999 for x in r.left)


def test_nothing_and_zero_vectors(spark, always):
    for values in ([], [""], ["", ""], ["a"]):
        rows = pool(spark, values) if values else pool(spark, [""]).limit(0)
        got = sorted((r.eval_id, r.class_id, r.links) for r in dedup.duplicate_classes(rows).collect())
        assert got == [(i, i, 0) for i in range(len(values))]
        assert dedup.first_wins(rows).filter("action <> 'accepted'").isEmpty()
