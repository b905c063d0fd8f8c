import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from goldsieve.llm.quality_rules import ORACLE, bucket, measure_texts, quality_rules, repeated_words, sketches
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines, seen = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)], set()
    counts = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if counts[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    dup = sum(x in seen or seen.add(x) is not None for x in lines)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


def test_measures():
    texts = [t for _, t in (r[:2] for r in EDGE)] + ["a b c d e a b c d e", "a a a a a a", "x\nx\n\nx \n|#|", "a b c d e f\n" * 3]
    got = measure_texts(texts)
    assert list(zip(*(got[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")))) == [brute(t) for t in texts]


def test_a_shared_hash_is_noticed(monkeypatch):
    """With multipliers that make all windows meet, others are tried."""
    real, calls = np.random.default_rng, []

    class Zeros:
        def integers(self, low, high, size, dtype):
            return np.zeros(size, dtype)

    monkeypatch.setattr(np.random, "default_rng", lambda seed: calls.append(seed) or (Zeros() if seed == 0 else real(seed)))
    ids = np.array([2, 4, 2, 4, 2, 4, 2, 6])
    ids[3] = 8
    assert not repeated_words(ids, np.zeros(8, int)).any() and calls == [0, 1]


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 1000, 12345, 1 << 40])
def test_buckets_keep_six_bits(spark, value):
    got = spark.range(1).select(bucket(F.lit(value).cast("bigint")).alias("b")).first().b
    shift = max(value.bit_length() - 6, 0)
    assert got == value >> shift << shift and value - got <= value / 32


def test_sketches_merge(docs):
    rows = [(i, "word " * (i % 50) + "#" * (i % 7), "en", "a") for i in range(300)]
    frame = quality_rules.__globals__["measured"](docs(rows), "text", [F.col("doc_id"), F.col("source")])
    whole = sorted(map(tuple, sketches(frame, ["source"]).collect()))
    parts = sketches(frame.filter("doc_id % 2 = 0"), ["source"]).union(sketches(frame.filter("doc_id % 2 = 1"), ["source"]))
    assert sorted(map(tuple, parts.groupBy("source", "rule", "bucket").agg(F.sum("n")).collect())) == whole


def test_edges_equal_sql(edge, clashing, docs):
    for frame in (edge, docs([(i, "plain words in a line of text here and there " * (1 + i % 5) + "#$" * (200 * (i % 19 == 0)), "en" if i % 2 else None, f"s{i % 2}") for i in range(200)])):
        got = quality_rules(frame).toPandas()
        given = frame.toPandas()  # noqa: F841
        want = duckdb.sql(ORACLE.replace("FROM documents", "FROM (SELECT row_number() OVER () AS doc_id, * EXCLUDE doc_id FROM given)")).df()
        names = [c for c in got.columns if c != "doc_id"]
        assert sorted(map(repr, got[names].values.tolist())) == sorted(map(repr, want[names].values.tolist()))
    assert quality_rules(clashing).count() == len(EDGE) and quality_rules(docs([])).count() == 0


def test_fences_follow_their_group(docs):
    plain = [(i, " ".join(f"{'ab' * (1 + k % 3)}{i}x{k}" for k in range(40)), "en", "a") for i in range(60)]
    marked = [(1000 + i, " ".join(f"w{1000 + i}x{k}#" + "#" * (k % 2) for k in range(40)), "en", "b") for i in range(60)]
    odd = [(5000, marked[0][1], "en", "a")]
    kept = {r.doc_id: r.kept for r in quality_rules(docs(plain + marked + odd)).collect()}
    assert not kept[5000] and all(v for k, v in kept.items() if k != 5000)
