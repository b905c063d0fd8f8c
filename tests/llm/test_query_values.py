"""Columns of registered queries, by plain Python over the small table."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash

from goldsieve.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op3(spark, small, documents):
    rows = {r.doc_id: r for r in QUERIES["op3_source_mix"](spark, small).collect()}
    assert set(rows) == set(documents)
    size = {d: len(WORDS.findall(r.text or "")) for d, r in documents.items()}
    sources = sorted({r.source for r in documents.values()}, key=lambda s: (s is None, s or ""))
    of = Counter()
    for d, r in documents.items():
        of[r.source] += size[d]
    target, open_ = {}, dict(zip(sources, [5, 2, 1] * len(sources)))
    left = sum(of.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * of[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * of[s]
            left -= target[s]
            del open_[s]
    taken, largest = Counter(), defaultdict(int)
    for d, r in rows.items():
        source = documents[d].source
        assert (r["size"], r.source_size) == (size[d], of[source]) and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * size[d] and (size[d] == 0 or r.taken % size[d] == 0)
        taken[source] += r.taken
        largest[source] = max(largest[source], size[d])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sources)


def fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4(spark, small, documents):
    prints = {d: fingerprint(r.text) for d, r in documents.items()}
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(label[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed |= low < label[a]
            label[a] = min(low, label[a])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, small).collect()}
    assert got == {d: (f"{p:016x}", label[d]) for d, p in prints.items()}


def test_op6_and_op10(spark, small, documents):
    quality = {r.doc_id: r for r in QUERIES["op6_quality_model"](spark, small).collect()}
    language = {r.doc_id: r for r in QUERIES["op10_language"](spark, small).collect()}
    assert set(quality) == set(language) == set(documents)
    learned = {r.lang for d, r in documents.items() if not held_out(d)}
    for d, r in documents.items():
        q, l = quality[d], language[d]  # noqa: E741
        assert q.held_out == l.held_out == held_out(d) and 0 <= q.score <= 1 and 0 <= l.score <= 1
        assert q.predicted == int(q.score >= 0.7)
        assert l.lang_pred in learned if regex.search(r"\p{L}", r.text or "") else l.lang_pred == "und"


def test_op8(spark, small, documents):
    rows = QUERIES["op8_shards"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        body = (documents[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        slots[r.shard].append(r.slot)
        homes[body].add(r.shard)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(r["size"] for r in rows)
    copies = Counter((documents[r.doc_id].text or "").encode() for r in rows)
    assert all(len(h) == 1 for b, h in homes.items() if copies[b] * (len(b) + 1) < total / 16)
