"""Latent vectors against numpy's own decomposition."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldsieve.functions.vectors import with_token_vector
from goldsieve.operators import latent
from goldsieve.operators.latent import lsa_vectors


def matrix(rows):
    """Unit rows of token counts, in the order of the given rows."""
    terms = sorted({t for r in rows for t in (r.terms or ())})
    column = {t: i for i, t in enumerate(terms)}
    out = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        for t, w in zip(r.terms, r.weights):
            out[i, column[t]] = w
        out[i] /= np.sqrt(r.norm2) or 1.0
    return out


@pytest.fixture(scope="module")
def vectors(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    return with_token_vector(docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id bigint, text string")), "text").cache()


def test_directions_are_those_of_the_whole_matrix(vectors):
    rows = vectors.orderBy("doc_id").collect()
    a = matrix(rows)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    found = {r.doc_id: r.vector for r in lsa_vectors(vectors, "doc_id", rank=8, more=12, rounds=4).collect()}
    got = np.array([found[r.doc_id] for r in rows])
    assert got.shape == (len(rows), 8) and not got[[i for i, r in enumerate(rows) if r.norm2 == 0]].any()
    assert np.linalg.norm(got, axis=0) == pytest.approx(s[:8], rel=0.01)
    gaps = s[:8] - s[1:9]
    lead = int(np.argmax(gaps[1:])) + 2  # up to the widest gap the span is well defined
    q = np.linalg.qr(got[:, :lead])[0]
    angles = np.linalg.svd(q.T @ u[:, :lead], compute_uv=False)
    assert angles.min() > 0.999


def test_defaults_keep_most_of_what_can_be_kept_and_ranks_may_run_out(spark, vectors):
    rows = vectors.orderBy("doc_id").collect()
    s = np.linalg.svd(matrix(rows), compute_uv=False)
    got = lsa_vectors(vectors, "doc_id").collect()
    energy = sum(x * x for r in got for x in r.vector)
    assert len(got) == len(rows) and energy > 0.97 * (s[:16] ** 2).sum()
    few = with_token_vector(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "")], "doc_id bigint, text string"), "text")
    found = {r.doc_id: np.array(r.vector) for r in lsa_vectors(few, "doc_id", rank=4).collect()}
    assert np.allclose(found[1], found[2]) and abs(found[1] @ found[3]) < 1e-9 and not found[4].any()
    assert np.linalg.norm(found[1]) == pytest.approx(1) and np.linalg.norm(found[3]) == pytest.approx(1)
    assert lsa_vectors(few.limit(0), "doc_id").count() == 0


def test_texts_are_tokenised_once_a_row_and_not_for_every_weight(spark):
    """A long text has thousands of weights; a length worked out inside their lambda took the square of that."""
    text = " ".join(f"w{i}" for i in range(60_000))
    long = with_token_vector(spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id bigint, text string"), "text")
    plan = long.select("terms", "weights", "norm2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    started = time.monotonic()
    found = {r.doc_id: np.array(r.vector) for r in lsa_vectors(long, "doc_id", rank=2).collect()}
    assert time.monotonic() - started < 120
    assert np.linalg.norm(found[1]) == pytest.approx(1) and np.linalg.norm(found[2]) == pytest.approx(1) and not found[3].any()


def test_blocks_do_not_matter_and_rows_of_a_key_are_summed(spark, monkeypatch):
    rows = [(i, f"a{i % 5} b{i % 7} c{i % 3} c{i % 3}") for i in range(60)] + [(3, "d e"), (4, "a4 b4 c1 c1"), (None, "a1 b1"), (61, None), (62, "")]
    vectors = with_token_vector(spark.createDataFrame(rows, "doc_id bigint, text string"), "text")
    want = sorted(map(str, (((r.doc_id, np.round(np.abs(r.vector), 6).tolist()) for r in lsa_vectors(vectors, "doc_id", rank=3).collect()))))
    monkeypatch.setattr(latent, "BLOCK_ENTRIES", 20)
    got = lsa_vectors(vectors, "doc_id", rank=3).collect()
    assert sorted(map(str, ((r.doc_id, np.round(np.abs(r.vector), 6).tolist()) for r in got))) == want and len(got) == len(rows)
    assert all(not any(r.vector) for r in got if r.doc_id in (None, 61, 62)) and all(any(r.vector) for r in got if r.doc_id in (0, 3, 59))
    assert np.allclose([r.vector for r in got if r.doc_id == 4][0], [r.vector for r in got if r.doc_id == 4][1])
