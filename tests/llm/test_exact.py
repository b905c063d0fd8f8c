import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldsieve.llm import exact_dedup
from goldsieve.llm.exact_dedup import exact_duplicates
from tests.llm.conftest import EDGE


def brute(rows, keep):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    pick = {t: (max if keep == "largest" else min)((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return sorted(
        ((k, pick[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows), key=repr
    ), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("sample", [1, 32])
def test_edge_cases(edge, keep, sample, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SAMPLE", sample)  # 1: every repeated text is hot and cut into slices
    got = exact_duplicates(edge, keep=keep).collect()
    want, groups = brute([r[:2] for r in EDGE], keep)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_text_over_many_slices(docs):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_duplicates(docs(rows), keep="largest").collect()
    hot = [r for r in got if r.doc_id % 3]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2999, 2000)} and [r.doc_id for r in hot if r.kept] == [2999]
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 3 == 0)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "a", "b", "ab", "a" * 100 + "x", "a" * 100 + "y"])), min_size=1, max_size=40))
def test_any_rows(docs, rows):
    got = exact_duplicates(docs(rows)).collect()
    want, groups = brute(rows, "smallest")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want and sum(r.kept for r in got) == groups


def test_normalised_clashing_empty(clashing, docs):
    assert exact_duplicates(clashing, normalise=lambda c: F.lower(F.trim(c))).count() == len(EDGE)
    assert exact_duplicates(docs([])).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(docs([]), keep="first")


def test_no_python(edge):
    plan = exact_duplicates(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
