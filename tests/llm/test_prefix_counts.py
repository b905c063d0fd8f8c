import public_tokenizers
import pytest
from tokenizers import Tokenizer

from goldsieve.llm.prefix_counts import counter, count_prefixes, longest_within, prefix_array, tokens_at
from goldsieve.llm.queries import QUERIES
from tests.llm.conftest import EDGE
from tests.llm.test_tokens import strange

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MORE = [
    "I'll we've they're 'l 'll''re  'rest", "a  \n\n b\n\nc   ", "　　y \xa0\xa0z", "\n\n\n<|endoftext|>\n\n<|endoftext|", "abab" * 40, "antidisestablishment",
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(BYTES)
    made.no_truncation()
    made.no_padding()
    return made


def test_every_prefix_counts_as_the_library_does(library):
    texts = strange(600, 3) + MORE
    for text, found in zip(texts, counter(BYTES).differences(texts)):
        counts = prefix_array(found.tobytes(), len(text))
        assert counts.tolist() == [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]


def test_counts_and_answers_in_spark(spark, edge, clashing, docs, library):
    counted = count_prefixes(edge, BYTES, carry=("doc_id", "text"))
    for r in counted.collect():
        text = r.row.text or ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_chars, r.n_tokens, len(r.prefix)) == (len(text.encode()), len(text), want, len(text))
    for r in tokens_at(counted, "cast(n_chars / 2 as int)").collect():
        text = (r["all"].row.text or "")[:r["all"].n_chars // 2]
        assert (r.prefix_chars, r.prefix_tokens) == (len(text), len(library.encode(text, add_special_tokens=False).ids))
    for budget in (0, 3, 9):
        for r in longest_within(counted.filter("n_chars < 100"), str(budget)).collect():
            text = r["all"].row.text or ""
            counts = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
            best = max(n for n, c in enumerate(counts) if c <= budget)
            assert (r.prefix_chars, r.prefix_tokens) == (best, counts[best])
    assert all(r.prefix_chars is None for r in longest_within(counted, "-1").collect())
    assert all(r.prefix_tokens is None for r in tokens_at(counted, "null").collect())
    assert count_prefixes(clashing, BYTES, carry=tuple(clashing.columns)).count() == len(EDGE)
    assert count_prefixes(docs([]), BYTES).count() == 0


def test_query_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_token_counts"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
