import random

import pytest
from pyspark.sql import functions as F

from goldsieve.llm import line_dedup
from goldsieve.llm.line_dedup import dedup_lines, within_one_edit
from tests.llm.conftest import EDGE


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def words(line):
    return tuple(w for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w)


def brute(rows, least):
    """What is left of each text, when keys are distinct and not null."""
    firsts, places = {}, []
    for key, text in sorted((r[:2] for r in rows), key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            if words(line):
                places.append((key, at, words(line)))
                firsts.setdefault(words(line), (key, at))
    gone = set()
    for key, at, own in places:
        close = any(firsts[o] < firsts[own] and len(own) >= least <= len(o) and near(own, o) for o in firsts if o != own)
        if close or firsts[own] != (key, at):
            gone.add((key, at))
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in (r[:2] for r in rows)}, gone


def test_against_brute_force(docs):
    rnd = random.Random(9)
    base = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    def edited(line):
        line, at = list(line), rnd.randrange(len(line))
        kind = rnd.random()
        if kind < 0.3:
            line[at] = "new" + str(rnd.randint(0, 3))
        elif kind < 0.5:
            del line[at]
        elif kind < 0.7:
            line.insert(at, line[at] if rnd.random() < 0.5 else "more")
        return ("  " if rnd.random() < 0.1 else " ").join(line)
    rows = [(i, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for i in range(90)]
    want, gone = brute(rows, 3)
    got = dedup_lines(docs(rows), least_words=3).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_dropped for r in got) == len(gone) and len(gone) > 50


def test_small_filter_lets_nothing_slip(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    rows = [(i, " ".join(f"w{k}" for k in range(12)).replace(f"w{i % 12}", f"z{i}")) for i in range(60)]
    want, _ = brute(rows, 10)
    assert {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()} == want


def test_a_template_in_most_rows(docs):
    rows = [(i, f"page {i} of the very long report that nobody wants to read\nown line number {i}") for i in range(400)]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own line number {i}" for i in range(1, 400))


def test_edges(edge, clashing, docs):
    got = dedup_lines(edge).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[1]] == [None] and [r.text for r in by[2]] == [""] and by[3][0].text == "  \n\t "
    assert by[4][0].text == by[5][0].text == "" and {r.text for r in by[None]} == {None, "one"}  # null keys come first
    assert [r.text for r in by[8]] == ["same line"] and by[8][0].n_dropped == 2
    assert [(r.text, r.n_dropped) for r in by[9]] == [("a b c d e f g h i j k l", 0)] * 2  # repeated rows are one document
    assert dedup_lines(clashing).columns == [c for c in clashing.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert dedup_lines(clashing).count() == len(EDGE) and dedup_lines(docs([])).count() == 0
    assert "Python" not in dedup_lines(edge)._jdf.queryExecution().toString()


@pytest.mark.parametrize("a,b,want", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b", "a x b", True), ("a a b", "a b", True), ("a b c", "c b a", False), ("a", "b", True), ("a b", "b a c", False), ("a b", "a b c d", False)])
def test_one_edit(spark, a, b, want):
    one = spark.range(1).select(F.array(*map(F.lit, a.split())).alias("a"), F.array(*map(F.lit, b.split())).alias("b"))
    row = one.select(within_one_edit(F.col("a"), F.col("b")).alias("x"), within_one_edit(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (want, want) == (near(a.split(), b.split()),) * 2


def test_lines_are_read_without_translating_them_and_most_texts_stay_where_they_are(docs):
    """Every character of every line went through translate, and every text through an exchange."""
    rows = [(i, f"only here {i}\nand {i} here\t too ") for i in range(50)] + [(50, "a b\n\x0b \t\n a\tb"), (51, " \x0c\r\nx")]
    plan = dedup_lines(docs(rows))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in text and "Union" in text
    got = {r.doc_id: r for r in plan.collect()}
    want, _ = brute(rows, 10)
    assert {k: r.text for k, r in got.items()} == want and want[50] == "a b\n\x0b \t"
    assert [got[k].n_lines for k in (0, 50, 51)] == [2, 2, 1] and [got[k].n_dropped for k in (0, 50, 51)] == [0, 1, 0]


@pytest.mark.parametrize("line", ["a b", " a b", "a b ", "a  b", "a\tb", "\x0ba\x0c b\r", "ä é", "a"])
def test_normal_lines(spark, line):
    one = spark.createDataFrame([(line,)], "line string").select(line_dedup._normal(F.col("line")).alias("x"), line_dedup._has_word(F.col("line")).alias("y"))
    assert one.first() == (" ".join(words(line)), True)
