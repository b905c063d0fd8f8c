import zlib

import numpy as np
import pytest

from goldsieve.llm.language import LONGEST, Labeller, Network, identify_languages, pieces, train_language_model
from goldsieve.llm.quality_model import DIMS, ROWS, Tokens, count_contexts, fit_classifier, index_vectors, pool, score_quality, token_vectors, tokenised
from tests.llm.conftest import EDGE


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_gradients_by_differences():
    net, rnd = Network(["a", "b", "c"], 5), np.random.default_rng(1)
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    data, target = rnd.integers(97, 105, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0, 2])
    _, grads = net.gradients(data, target)
    for k, part in net.parts.items():
        for at in rnd.permutation(np.argwhere(np.abs(grads[k]) > 1e-4))[:5]:
            at, kept = tuple(at), part[tuple(at)]
            part[at] = kept + 1e-3
            up = net.gradients(data, target)[0]
            part[at] = kept - 1e-3
            down = net.gradients(data, target)[0]
            part[at] = kept
            assert grads[k][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-5)


def test_labeller_sums_all_positions():
    net = Network(["a", "b"])
    text = "abc déf " + "x" * 60 + " ABC 12 "
    (label, score), = Labeller(net).label([text])
    probs = [net.positions(np.frombuffer(p, np.uint8)[None])[:, 0] for w in ("abc", "déf", "x" * 60, "abc") for p in pieces(w.encode())]
    want = np.concatenate(probs).mean(axis=0)
    assert label == net.languages[int(want.argmax())] and score == pytest.approx(float(want.max()), abs=1e-5)
    assert max(len(p) for p in pieces(b"y" * 100)) <= LONGEST and b"".join(pieces(b"y" * 100)) == b"y" * 100


def test_languages_held_out(spark, middle):
    docs = documents(spark, middle)
    got = identify_languages(docs, train_language_model(docs, steps=500)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_languages_at_the_edges(edge, clashing, docs):
    model = train_language_model(docs([(i, w * 5, lang) for i, (w, lang) in enumerate([("the house ", "en"), ("das schloß ", "de")] * 6)]), steps=60)
    got = identify_languages(edge, model).collect()
    assert len(got) == len(EDGE) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 12, 13, None}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert identify_languages(clashing, model, carry=("row", "score")).count() == len(EDGE)
    assert identify_languages(docs([]), model).count() == 0
    nothing = train_language_model(docs([(1, "some text")]))  # no label
    assert nothing.languages == [] and [r.lang_pred for r in identify_languages(docs([(1, "some text")]), nothing).collect()] == ["und"]
    assert train_language_model(docs([])).languages == []


def test_labels_of_the_held_out_fold_teach_nothing(docs):
    rows = [(i, "alpha beta gamma", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(60)]
    assert train_language_model(docs(rows)).languages == ["yy"]


def test_context_counts():
    at, signs = index_vectors()
    rows, doc = np.array([5, 9, 5, 7]), np.array([0, 0, 0, 1])
    got = count_contexts(rows, doc, at, signs).reshape(ROWS, DIMS)
    vector = lambda r: sum(np.eye(DIMS, dtype=int)[a] * s for a, s in zip(at[r], signs[r]))
    assert (got[5] == 2 * vector(9) + 2 * vector(5)).all() and (got[9] == 2 * vector(5)).all() and not got[7].any()


def test_vectors_do_not_depend_on_partitions(spark, middle):
    docs = documents(spark, middle).limit(200)
    assert np.array_equal(token_vectors(tokenised(docs.repartition(1))), token_vectors(tokenised(docs.repartition(7))))


def test_pools():
    vectors = np.random.default_rng(0).standard_normal((ROWS, DIMS)).astype(np.float32)
    rows, doc = Tokens().of(["a b a", "", None, "c"])
    got = pool(rows, doc, 4, vectors)
    each = vectors[[zlib.crc32(t) % ROWS for t in (b"a", b"b", b"a")]]
    assert np.allclose(got[0, :DIMS], each.mean(axis=0), atol=1e-5) and np.allclose(got[0, DIMS:2 * DIMS], each.std(axis=0), atol=1e-4)
    assert not got[1].any() and not got[2].any() and got[3, -1] == pytest.approx(np.log(2))


def test_temperature_calibrates():
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((4000, 6))
    y = (rnd.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = fit_classifier(x, y)
    scores = model.scores(x)
    for low in (0.1, 0.4, 0.7):
        chosen = (scores > low) & (scores < low + 0.2)
        assert abs(y[chosen].mean() - scores[chosen].mean()) < 0.08


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    got = score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_at_the_edges(spark, edge, clashing, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)] + [(None, 1), (3, None), (99, 0), (4, 1)], "doc_id bigint, quality int")
    got = score_quality(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert score_quality(clashing, labels).count() == len(EDGE) and score_quality(docs([]), labels).count() == 0
    assert {r.score for r in score_quality(edge, labels.limit(0)).collect()} == {0.5}
