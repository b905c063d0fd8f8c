import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from goldsieve.llm import bpe, token_output
from goldsieve.llm.bpe import bpe_decode, bpe_encode, bpe_encode_decode, decode_ids, encode_texts, vocabulary
from goldsieve.llm.common import scratch
from goldsieve.llm.queries import QUERIES
from goldsieve.llm.token_output import STEP, Code, WordEncoder, code_lengths, pack, read_tokens, unpack, write_tokens
from tests.llm.conftest import EDGE

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "B", " ", "  ", "\n", "'s", "'LL", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "1", "22", " ", "\t", "!!", "aaaa", "漢字", "́",
    "'", "\x1c", "\x85", "𝒳", "<|", "the", " The", "Σ", " ", "\x00", "‍",
]


def strange(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library():
    vocab, library = vocabulary(BYTES), Tokenizer.from_file(BYTES)
    texts = strange(3000, 1) + [t or "" for _, t in (r[:2] for r in EDGE)]
    for batch in (texts[:1500], texts[1500:]):
        for text, ids in zip(batch, encode_texts(batch, vocab)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert decode_ids(ids, vocab) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_decoding_any_ids_replaces_broken_bytes():
    vocab, library, rnd = vocabulary(BYTES), Tokenizer.from_file(BYTES), random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 9))]
        assert decode_ids(np.array(ids, np.int64), vocab) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("stretch", [100, 32 << 20])
def test_bpe_round_trip_in_spark(edge, clashing, docs, stretch, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    rows = bpe_decode(bpe_encode(edge, BYTES, carry=("doc_id", "text")), BYTES, carry=("doc_id",)).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((k, t or "") for k, t in (r[:2] for r in EDGE)), key=repr)
    both = bpe_encode_decode(edge, BYTES, carry=("doc_id", "text")).collect()
    assert all(r.decoded == (r.text or "") for r in both) and len(both) == len(EDGE)
    assert bpe_encode(clashing, BYTES, carry=("doc_id", "row", "key")).columns == ["doc_id", "row", "key", "ids"]
    assert bpe_encode(docs([]), BYTES).count() == 0


def test_merges_that_do_not_ascend_are_refused(tmp_path):
    import json

    data = json.load(open(BYTES, encoding="utf-8"))
    data["model"]["merges"] = data["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 500)
    mine, library = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = strange(3000, 2)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        ids, sizes = mine.encode(part, 1)
        for text, got in zip(part, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("limit", [4, 8, 20])
def test_code_lengths_are_best_within_the_limit(limit):
    rnd = np.random.default_rng(limit)
    for n in (1, 2, 3, 12, 16):
        counts = rnd.integers(1, 2 ** rnd.integers(1, 24, n), n, endpoint=True)
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and (n == 1 or sum(2.0 ** -lengths) == 1)
        assert int((lengths * counts).sum()) == best_cost(counts, limit)
    with pytest.raises(ValueError):
        code_lengths(np.ones(17, int), 4)


def best_cost(counts, limit):
    """Least total bits over all monotone code shapes, by search over numbers of codes at each depth."""
    counts = sorted(counts.tolist(), reverse=True)
    if len(counts) == 1:
        return counts[0]
    best = {(0, 2): 0}  # (symbols placed, open nodes at this depth): bits
    found = []
    for depth in range(1, limit + 1):
        new = {}
        for (placed, nodes), bits in best.items():
            for here in range(min(nodes, len(counts) - placed) + 1):
                total, after = bits + depth * sum(counts[placed:placed + here]), placed + here
                if after == len(counts):
                    found.append(total)
                elif (key := (after, min(2 * (nodes - here), 2 * len(counts)))) and key[1] and total < new.get(key, total + 1):
                    new[key] = total
        best = new
    return min(found)


def test_pack_and_unpack():
    rnd = np.random.default_rng(4)
    ids = np.array([3, 7, 8, 100, 49407])
    code = Code(ids, code_lengths(np.array([1000, 300, 20, 5, 1])))
    sizes = np.array([1, 0, STEP, STEP + 1, 5000, 2])
    values = rnd.choice(ids, int(sizes.sum()), p=[0.7, 0.2, 0.05, 0.03, 0.02])
    bits, marks = pack(values, sizes, code)
    for doc, want in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
        n = -(-len(want) // STEP)
        lengths = np.full(n, STEP)
        lengths[-1:] = len(want) - (n - 1) * STEP
        assert unpack(bits[doc], np.frombuffer(marks[doc], "<u8").astype(np.int64), lengths, code.table, code.depth).tolist() == want.tolist()


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_files_read_back(spark, edge, block, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", block)
    folder, library = scratch(spark, "test"), Tokenizer.from_file(WORDS)
    write_tokens(edge, folder, WORDS)
    got = read_tokens(spark, folder).orderBy("start").collect()
    want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in (r[:2] for r in EDGE)]
    assert [r.id for r in got] == sorted((k for k, _ in want), key=lambda k: (k is not None, k))
    assert sorted(((r.id, r.n_tokens, digest(np.frombuffer(r.ids, "<u4"))) for r in got), key=repr) == sorted(((k, len(i), digest(i)) for k, i in want), key=repr)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_empty_and_clashing(spark, docs, clashing):
    folder = scratch(spark, "test")
    write_tokens(docs([]), folder, WORDS)
    assert read_tokens(spark, folder).count() == 0
    folder = scratch(spark, "test")
    write_tokens(clashing, folder, WORDS)
    assert read_tokens(spark, folder).count() == len(EDGE)


def test_op5_query_equals_the_library(spark, small):
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op1_query_equals_the_library(spark, small):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), digest(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op1_token_output"](spark, small).collect())) == want
