import math
import re

import pytest

from goldsieve.llm.mixing import mix_sources, targets
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_water_filling():
    assert targets([100, 100], [1, 1]) == [100, 100]
    assert targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert targets([0, 0], [1, 1]) == [0, 0]
    assert sum(targets([1, 2, 1000], [5, 2, 1])) == pytest.approx(1003)


def expected(rows):
    """Targets and rates by a plain search for each multiplier."""
    by = {}
    for key, text, _, source in rows:
        by.setdefault(source, []).append(len(WORD.findall(text or "")))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, targets([sum(by[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    rates = {}
    for n in names:
        low, high, mean = -700.0, 700.0, max(sum(by[n]) / len(by[n]), 1e-9)
        rate = lambda x, at, mean=mean: min(3.0, math.exp(min(at * x / mean, 5)))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(x * rate(x, mid) for x in by[n]) < wanted[n] else (low, mid)
        full = wanted[n] >= 3 * sum(by[n]) * (1 - 1e-12)
        rates[n] = {x: 3.0 if full else rate(x, low) for x in by[n]}
    return wanted, rates


def test_rates_and_rounding(docs):
    rows = [(i, "word " * (1 + i * 7919 % 211), "en", f"s{i % 4}" if i % 11 else None) for i in range(1200)]
    got = mix_sources(docs(rows)).collect()
    wanted, rates = expected(rows)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(wanted, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(wanted[s]) and r.taken == r.copies * r.size <= 3 * r.size
        rate = rates[s][r.size]
        assert math.floor(rate - 1e-6) <= r.copies <= math.ceil(rate + 1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 8 for s in wanted)
    again = mix_sources(docs(rows[::-1])).collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}


def test_edges(docs, clashing):
    rows = [r + (None, "a" if i % 2 else None) for i, r in enumerate(EDGE)]
    got = mix_sources(docs(rows), carry=("text",)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size and r.size == len(WORD.findall(r.text or "")) for r in got)
    assert mix_sources(clashing, carry=tuple(clashing.columns)[5:]).count() == len(EDGE)
    assert mix_sources(docs([])).count() == 0
    assert [r.taken for r in mix_sources(docs([(1, None, None, "a"), (2, "", None, "b")])).collect()] == [0, 0]


def test_one_size_in_most_rows(docs):
    rows = [(i, "a b c d", None, "hot" if i % 3 else "cold") for i in range(2000)]
    got = mix_sources(docs(rows)).collect()
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 4
