import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from goldsieve.llm.periodic_runs import Grammar, collapse, pair_up, periodic_runs, re_pair, runs_of_texts
from goldsieve.llm.queries import QUERIES
from tests.llm.conftest import EDGE


def plain_runs(words):
    """Every maximal stretch by trying all periods."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any((i, j + q - i, p) in out for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            block = [rnd.choice("abcde"[:rnd.randint(1, 5)]) for _ in range(rnd.randint(1, 9))]
            part = (block * rnd.randint(1, 9))[:rnd.randint(1, 60)]
            if rnd.random() < 0.3 and part:
                part[rnd.randrange(len(part))] = "z"
            words += part
        yield " ".join(words)


def test_runs_are_those_of_all_periods():
    texts = list(texts_with_runs(1, 1500))
    for text, (words, runs) in zip(texts, runs_of_texts(texts)):
        assert runs == plain_runs(text.split()), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_runs_of_two_letters(words):
    assert runs_of_texts([" ".join(words)])[0][1] == plain_runs(words)


def test_grammar_gives_back_the_sequence():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300, 3000):
        words = rnd.integers(0, 5, n)
        grammar = Grammar(5)
        seq, place = re_pair(words, grammar)
        pairs = list(zip(seq[:-1].tolist(), seq[1:].tolist()))
        assert all(len([i for i, p in enumerate(pairs) if p == q]) < 2 or q[0] == q[1] for q in set(pairs))
        roots, _ = pair_up(seq, place, np.zeros(len(seq), int), grammar)
        grammar.close()

        def spell(symbol):
            if symbol < 5:
                return [symbol]
            return spell(int(grammar.left[symbol - 5])) + spell(int(grammar.right[symbol - 5]))

        assert [w for r in roots.tolist() for w in spell(r)] == words.tolist() and len(roots) <= 1
        for symbol in range(5, grammar.made):
            at = int(grammar.first[symbol - 5])
            assert words[at:at + int(grammar.size[symbol])].tolist() == spell(symbol)


def test_long_runs_take_logarithmic_rules():
    [(words, runs)] = runs_of_texts(["w " * 100_000])
    assert runs == [(0, 100_000, 1)] and collapse(words, runs) == b"w"
    [(_, runs)] = runs_of_texts(["a b a b c " * 20_000])
    assert runs == [(0, 100_000, 5)]


def test_edges_in_spark(edge, clashing, docs):
    for r in periodic_runs(edge, carry=("doc_id", "text")).collect():
        words = (r.row.text or "").encode().split()
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in map(tuple, r.runs))]
        assert r.collapsed == b" ".join(kept).decode()
    assert periodic_runs(clashing, carry=tuple(clashing.columns)).count() == len(EDGE)
    assert periodic_runs(docs([])).count() == 0


def planted(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.fixture
def folder(spark, docs, tmp_path):
    rows = [r for r in EDGE if r[0] not in (10, 11)]
    rows += [(100 + i, t) for i, t in enumerate(texts_with_runs(5, 200))]
    docs(rows, extra=", `words` string, `n` string, `row` string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_query_equals_brute_force(spark, folder):
    path, rows = folder
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, path).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_query_on_the_small_table(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 6000").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, small).collect()}
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in texts)


