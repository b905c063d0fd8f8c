import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from goldsieve.llm.conversation_repair import CHUNK_ROWS, Row, best, conversation_digests, edited, parse, repair_conversations
from goldsieve.llm.queries import ORACLES, QUERIES, with_faults

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """The least (cost, edits) over all edits of a few rows."""
    inserts = [(n, "".join(r)) for n in range(3) for r in itertools.product("ua", repeat=n)]
    found = []
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(n for n, _ in gaps) > 2:
            continue
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, roles = 5 * sum(n for n, _ in gaps), "I" * gaps[0][0], gaps[0][1]
            for row, edit, (n, put) in zip(rows, edits, gaps[1:]):
                if edit != "D" and row.must_go:
                    break
                cost += 2 if edit == "D" else (edit != "K") + 5 * row.truncated
                roles += ("" if edit == "D" else row.initial if edit == "K" else edit) + put
                audit += ("R" if edit in "ua" else edit) + "I" * n
            else:
                if LEGAL.fullmatch(roles):
                    found.append((cost, audit))
    return min(found)


def test_parsing_finds_the_cheapest_edits():
    rnd = random.Random(2)
    for _ in range(150):
        rows = [Row(rnd.choice("suat"), rnd.random() < 0.15, rnd.random() < 0.25) for _ in range(rnd.randint(0, 3))]
        top = best(parse(rows))
        assert (top.cost, top.audit) == cheapest(rows), rows
        kept = edited(top.audit, [(r.initial, "x") for r in rows])
        assert LEGAL.fullmatch("".join(k["role"][0] for k in kept))


def conversations(seed, n):
    rnd = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", " \t", "Why?", "a b. ", "é\n.", None]
    roles = ["user", "assistant", "system", "tool", "", None]
    for conv in range(n):
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(roles) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            yield (conv if conv % 50 else None, rnd.choice([turn, turn, turn + 1, None]), role, rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}.")
    for turn in range(700):  # one conversation that holds a third of all rows
        yield 10_000, turn if turn % 90 else None, ("user", "assistant", "system")[turn % 3 if turn % 7 == 0 else turn % 2], rnd.choice(["ok.", "ok", f"t{turn}!"])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    rows = list(conversations(1, 200))
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", who string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    relation = con.sql(ORACLES["op13_conversation_repair"])
    return path, relation.columns, sorted(relation.fetchall(), key=repr)


def test_query_equals_sql(spark, table):
    path, columns, want = table
    got = QUERIES["op13_conversation_repair"](spark, path)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("rows,letters", [(1, 1 << 20), (3, 1 << 20), (CHUNK_ROWS, 40)])
def test_chunks_give_the_same(spark, table, rows, letters):
    path, columns, want = table
    hurt = with_faults(spark.read.parquet(f"{path}/conversations.parquet"))
    pieces = repair_conversations(hurt, absent="absent", chunk_rows=rows, chunk_letters=letters).cache()
    assert pieces.filter("n_pieces > 5").count() > 0
    assert sorted((tuple(r) for r in conversation_digests(pieces).select(*columns).collect()), key=repr) == want
    lines = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        lines.setdefault(r.conv_id, []).extend(f"{x.role}:{x.text}" for x in r.repaired)
    digest = {r[columns.index("conv_id")]: r[columns.index("repaired_sha256")] for r in want}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == digest
    pieces.unpersist()


def test_edges(spark):
    def result(rows, schema=SCHEMA, **more):
        return {r.conv_id: r for r in conversation_digests(repair_conversations(spark.createDataFrame(rows, schema), **more)).collect()}

    assert result([]) == {}
    [r] = result([(None, None, None, None)]).values()
    assert (r.conv_id, r.gaps, r.blank, r.cost, r.audit) == (None, 0, 1, 2, "D")
    got = result([(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "y."), (2, 5, "user", "a."), (2, 5, "user", "a."), (2, 9, "assistant", "b.")])
    assert (got[1].cost, got[1].audit) == (0, "KK") and (got[2].gaps, got[2].duplicate, got[2].audit) == (3, 1, "KDK")
    empty = hashlib.sha256(b"").hexdigest()
    gone = result([(1, 0, "user", "a.", True)], SCHEMA + ", absent boolean", absent="absent")[1]
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", empty)


def test_faults_fall_where_the_hash_says(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)], SCHEMA)
    hurt = with_faults(rows).withColumn("h", F.expr("crc32(cast(concat(conv_id, ':', turn) as binary)) % 20")).collect()
    for r in hurt:
        assert r.absent == (r.h == 0) and r.role == ("user" if r.h == 4 else "assistant")
        assert r.text == {1: "", 2: "One Two"}.get(r.h, "One. Two!")
    assert len(hurt) == 200 + sum(r.h == 3 for r in hurt) // 2
