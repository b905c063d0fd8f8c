"""Cheapest repair of the role structure of conversations, by generalised LR parsing.

A conversation is to read ``(system? (user assistant)+)?``. Rows are shifted, deleted or given another role, and empty rows may
be put in, each at a price. All ways to do so are parsed side by side on a graph of stacks: a node is a state of the
automaton over the node below it, and where two stacks end in the same state only the cheaper one stays, of equally cheap
ones the one whose letters of edits (``D``, ``I``, ``K``, ``R``) come first. Two stacks that have read the same rows at the same
price never hold one's edits as the beginning of the other's, so what comes later cannot turn their order around.

Rows are range-partitioned by conversation and turn. A conversation inside a partition is repaired there. One that crosses
into another, or is long, is cut into chunks: for every state at a chunk's start the best way to every state at its end is found
by itself, and these ways are joined in order. So no task holds the rows of a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import WORD, partitions, small_batches, stored

#: Rows, and letters of text, of the conversations that are repaired in one go, and of a chunk of longer ones.
CHUNK_ROWS, CHUNK_LETTERS = 4096, 4 << 20

#: Prices of edits; a truncated row that stays costs ``TRUNCATED`` besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}

# The automaton of C -> (nothing) | P | s P, P -> T | P T, T -> u a. States: 0 start, 1 after s, 2 after u, 3 after P, 4 after u a,
# 5 after T with no P before it, 6 after s P, 7 after P T.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (6, "u"): 2, (2, "a"): 4}
REDUCE = {4: (2, "T"), 5: (1, "P"), 7: (2, "P")}
GOTO = {(0, "P"): 3, (1, "P"): 6, (0, "T"): 5, (1, "T"): 5, (3, "T"): 7, (6, "T"): 7}
ACCEPT = (0, 3, 6)
#: A stack for every state in which a chunk can begin.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 6: (0, 1, 6)}


class Node(NamedTuple):
    state: int
    below: Node | None
    cost: int = 0
    audit: str = ""


class Row(NamedTuple):
    initial: str
    must_go: bool
    truncated: bool


def shifted(node: Node, symbol: str, cost: int, edit: str) -> Node | None:
    """The node after reading a symbol and reducing as long as a rule is complete, or None."""
    state = SHIFT.get((node.state, symbol))
    if state is None:
        return None
    top = Node(state, node)
    while top.state in REDUCE:
        size, symbol = REDUCE[top.state]
        for _ in range(size):
            top = top.below
        top = Node(GOTO[top.state, symbol], top)
    return Node(top.state, top.below, node.cost + cost, node.audit + edit)


def put(tops: dict[int, Node], node: Node | None) -> bool:
    """Keeps the cheaper of two stacks that end in the same state."""
    if node is None:
        return False
    known = tops.get(node.state)
    if known is not None and (known.cost, known.audit) <= (node.cost, node.audit):
        return False
    tops[node.state] = node
    return True


def with_inserts(tops: dict[int, Node]) -> dict[int, Node]:
    todo = list(tops)
    while todo:
        node = tops[todo.pop()]
        for symbol in NAMES:
            new = shifted(node, symbol, INSERT, "I")
            if put(tops, new):
                todo.append(new.state)
    return tops


def parse(rows: Iterable[Row], start: int = 0) -> dict[int, Node]:
    """The best stack for every state after the rows, from the state ``start``."""
    stack = None
    for state in STACKS[start]:
        stack = Node(state, stack)
    tops = with_inserts({start: stack})
    for row in rows:
        after: dict[int, Node] = {}
        more = TRUNCATED if row.truncated else 0
        for node in tops.values():
            put(after, node._replace(cost=node.cost + DELETE, audit=node.audit + "D"))
            if not row.must_go:
                put(after, shifted(node, row.initial, more, "K"))
                for symbol in NAMES:
                    put(after, shifted(node, symbol, REROLE + more, "R"))
        tops = with_inserts(after)
    return tops


def best(tops: dict[int, Node]) -> Node:
    return min((tops[s] for s in ACCEPT if s in tops), key=lambda n: (n.cost, n.audit))


def edited(audit: str, rows: list[tuple[str, str]], start: int = 0) -> list[dict[str, str]]:
    """The rows (role, text) that the edits leave, each with its edit."""
    out, at, user_next = [], 0, start != 2
    for edit in audit:
        role, text = (None, "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["u" if user_next else "a"]
        user_next = role[:1] != "u"
        out.append({"edit": edit, "role": role, "text": text})
    return out


class Facts(NamedTuple):
    """What is counted in consecutive rows, and what it takes to join it to the rows before."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0


def facts(rows: Iterable[tuple[str, int | None, bool, bool, bool]]) -> Facts:
    """Of rows (initial, turn, blank, duplicate, truncated) in order of their turns."""
    n = [0, 0, 0, 0]
    first = last = low = high = None
    turns = 0
    for initial, turn, blank, duplicate, truncated in rows:
        n[0] += blank
        n[1] += duplicate
        n[2] += truncated
        if last is None:
            first = initial
        else:
            n[3] += last + initial not in ("su", "ua", "au")
        last = initial
        if turn is not None:
            low = turn if low is None else low
            turns += turn != high
            high = turn
    return Facts(*n, first, last, low, high, turns)


def gaps(found: Facts, before: int | None = None) -> int:
    """Turns that are missing, here and since the last turn ``before``."""
    if found.low is None:
        return 0
    if before is None:
        return found.high - found.low + 1 - found.turns
    return found.high - before - (found.turns - (found.low == before))


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "repaired array<struct<edit:string,role:string,text:string>>"
REPAIRED_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FACTS = (
    "n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
)


def solve(rows: list[tuple]) -> dict:
    """The result of a whole conversation from rows (turn, role, text, is_blank, cut_off) in order."""
    seen, flagged = set(), []
    for turn, role, text, is_blank, cut_off in rows:
        again = not is_blank and (role, text) in seen
        seen.add((role, text))
        flagged.append((role[:1], turn, is_blank, again, cut_off and not again))
    found = facts(flagged)
    top = best(parse(Row(i, b or d, t) for i, _, b, d, t in flagged))
    return {
        "gaps": gaps(found), "blank": found.blank, "duplicate": found.duplicate, "truncated": found.truncated, "illegal": found.illegal,
        "cost": top.cost, "audit": top.audit, "repaired": edited(top.audit, [r[1:3] for r in rows]),
    }


def _first_pass(kind: pa.DataType, limit_rows: int, limit_letters: int):
    """Repairs conversations that lie inside a sorted partition; rows of the others pass, numbered and cut into chunks."""
    loose_names = ("turn", "role", "text", "is_blank", "cut_off", "absent")
    types = [
        pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held, letters, who, conv, first, loose = [], 0, None, None, True, False
        pos = chunk = in_chunk = chunk_letters = 0

        def drain(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 2000 or sum(r["size"] for r in out[-50:]) > limit_letters):
                columns = [pa.array([r["loose"] for r in out], pa.bool_()), pa.array([r["who"] for r in out], pa.string()), pa.array([r["conv"] for r in out], kind)]
                columns += [pa.array([r.get(n) for r in out], pa.int64()) for n in ("part", "chunk", "pos")]
                columns += [pa.array([r.get(n) for r in out], t) for n, t in zip(loose_names, types)]
                columns += [pa.array([r.get(n) if not r["loose"] else None for r in out], pa.int64()) for n in COUNTS]
                columns += [pa.array([r.get("audit") for r in out], pa.string()), pa.array([r.get("repaired") for r in out], REPAIRED_ARROW)]
                names = ["loose", "who", "conv", "part", "chunk", "pos", *(n if n not in COUNTS else n for n in loose_names), *COUNTS, "audit", "repaired"]
                yield pa.RecordBatch.from_arrays(columns, names)
                out.clear()

        def pass_on(rows: list[tuple]) -> None:
            nonlocal pos, chunk, in_chunk, chunk_letters
            for row in rows:
                size = len(row[2])
                if in_chunk and (in_chunk >= limit_rows or chunk_letters + size > limit_letters):
                    chunk, in_chunk, chunk_letters = chunk + 1, 0, 0
                out.append({"loose": True, "who": who, "conv": conv, "part": part, "chunk": chunk, "pos": pos, "size": size, **dict(zip(loose_names, row))})
                pos, in_chunk, chunk_letters = pos + 1, in_chunk + 1, chunk_letters + size

        def finish(last: bool) -> None:
            nonlocal chunk, in_chunk, chunk_letters
            if first or last or loose:
                pass_on(held)
                chunk, in_chunk, chunk_letters = chunk + 1, 0, 0
            else:
                out.append({"loose": False, "who": who, "conv": conv, "size": letters, **solve([r[:5] for r in held if not r[5]])})

        any_rows = False
        for batch in small_batches(batches, "text", limit_letters):
            for row in zip(*(batch.column(n).to_pylist() for n in ("who", "conv", *loose_names))):
                if any_rows and row[0] != who:
                    finish(False)
                    held, letters, first, loose = [], 0, False, False
                    yield from drain()
                any_rows, who, conv = True, row[0], row[1]
                held.append(row[2:])
                letters += len(row[4])
                if len(held) > limit_rows or letters > limit_letters:
                    loose = True
                if loose:
                    pass_on(held)
                    held, letters = [], 0
                    yield from drain()
        if any_rows:
            finish(True)
        yield from drain(True)

    return run


def _chunk_ways(table: pa.Table) -> pa.Table:
    """The facts of a chunk and, for every state before it, the price and edits of the best way to every state after it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    there = [r for r in rows if not r["absent"]]
    found = facts((r["initial"], r["turn"], r["is_blank"], r["again"], r["cut_off"]) for r in there)
    ways = []
    for start in STACKS:
        tops = parse((Row(r["initial"], r["is_blank"] or r["again"], r["cut_off"]) for r in there), start)
        ways += [{"start": start, "end": n.state, "cost": n.cost, "audit": n.audit} for n in tops.values()]
    head = rows[0]
    names = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last", "low", "high", "turns")
    out = {"who": [head["who"]], "part": [head["part"]], "chunk": [head["chunk"]], **{n: [v] for n, v in zip(names, found)}, "ways": [ways]}
    return pa.table(out, schema=WAYS_ARROW)


WAYS = f"who string, part bigint, chunk bigint, {FACTS}, ways array<struct<start:bigint,end:bigint,cost:bigint,audit:string>>"
WAYS_ARROW = pa.schema([
    ("who", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), *((n, pa.int64()) for n in ("n_blank", "n_duplicate", "n_truncated", "n_illegal")),
    ("first", pa.string()), ("last", pa.string()), *((n, pa.int64()) for n in ("low", "high", "turns")),
    ("ways", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
PIECES_ARROW = pa.schema([
    ("who", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("piece", pa.int64()), ("n_pieces", pa.int64()), ("start", pa.int64()),
    *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()),
])
PIECES = f"who string, part bigint, chunk bigint, piece bigint, n_pieces bigint, start bigint, {RESULT}"


def _join_ways(table: pa.Table) -> pa.Table:
    """The chunks of one conversation in order, each with the way that the cheapest repair of the whole takes through it."""
    chunks = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]))
    tops: dict[int, tuple[int, str]] = {0: (0, "")}
    came = []
    for chunk in chunks:
        after: dict[int, tuple[int, str]] = {}
        way: dict[int, dict] = {}
        for w in chunk["ways"]:
            if w["start"] in tops:
                cost, audit = tops[w["start"]]
                if w["end"] not in after or (cost + w["cost"], audit + w["audit"]) < after[w["end"]]:
                    after[w["end"]], way[w["end"]] = (cost + w["cost"], audit + w["audit"]), w
        tops = after
        came.append(way)
    state = min((s for s in ACCEPT if s in tops), key=lambda s: tops[s])
    out, picked = [], []
    for way in reversed(came):
        picked.append(way[state])
        state = way[state]["start"]
    turn = last = None
    for n, (chunk, way) in enumerate(zip(chunks, reversed(picked))):
        found = Facts(*(chunk[k] for k in ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last", "low", "high", "turns")))
        border = last is not None and found.first is not None and last + found.first not in ("su", "ua", "au")
        out.append({
            "who": chunk["who"], "part": chunk["part"], "chunk": chunk["chunk"], "piece": n, "n_pieces": len(chunks), "start": way["start"],
            "gaps": gaps(found, turn), "blank": found.blank, "duplicate": found.duplicate, "truncated": found.truncated,
            "illegal": found.illegal + border, "cost": way["cost"], "audit": way["audit"],
        })
        turn = found.high if found.high is not None else turn
        last = found.last if found.last is not None else last
    return pa.Table.from_pylist(out, schema=PIECES_ARROW)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None,
    chunk_rows: int = CHUNK_ROWS, chunk_letters: int = CHUNK_LETTERS,
) -> DataFrame:
    """Pieces of repaired conversations: ``conv``, ``piece``, ``n_pieces``, counts, ``cost``, ``audit`` and ``repaired``.

    Most conversations are one piece. Those that are long, or cross a border between partitions, have more; their counts add up and
    their ``audit`` and ``repaired`` rows (edit, role, text) follow one another by ``piece``. Counted are ``gaps`` in the turns,
    faulty rows by their first fault (``blank``, ``duplicate`` of an earlier row, ``truncated``) and ``illegal`` neighbours.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null role or text counts as one space,
    null conversations are one. Repeated rows are duplicates. A row with ``absent`` true is no row, but names its conversation, which
    is reported even if nothing else is left of it. Other columns are not read, so names cannot clash. An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(" "))
    held = rows.select(
        key.alias("who"), F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        body.alias("text"), (~body.rlike(WORD)).alias("is_blank"), (body.rlike(WORD) & ~body.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
        (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"),
    )
    order = ["who", F.col("turn").asc_nulls_first(), "role"]
    dealt = held.repartitionByRange(partitions(spark), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    kind = held.schema["conv"].dataType.simpleString()
    arrow_kind = held.select("conv").limit(0).toArrow().schema.field("conv").type
    loose_columns = "turn bigint, role string, text string, is_blank boolean, cut_off boolean, absent boolean"
    first = stored(dealt.mapInArrow(
        _first_pass(arrow_kind, chunk_rows, chunk_letters),
        f"loose boolean, who string, conv {kind}, part bigint, chunk bigint, pos bigint, {loose_columns}, {RESULT}, {REPAIRED}",
    ), "repair")
    done = first.filter("not loose").select("conv", F.lit(0).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("n_pieces"), *COUNTS, "audit", "repaired")

    loose = first.filter("loose").select("who", "conv", "part", "chunk", "pos", "turn", "role", "text", "is_blank", "cut_off", "absent")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    marked = loose.select("who", "part", "chunk", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "is_blank", "cut_off", "absent", same.alias("same"))
    place = F.struct("part", "pos")
    earliest = marked.filter("not absent").groupBy("who", "same").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    flagged = marked.join(earliest, ["who", "same"], "left").withColumn(
        "again", F.coalesce(~F.col("is_blank") & (place > F.col("earliest")), F.lit(False))
    ).withColumn("cut_off", F.col("cut_off") & ~F.col("again"))
    ways = flagged.drop("same", "earliest").groupBy("who", "part", "chunk").applyInArrow(_chunk_ways, WAYS)
    pieces = stored(ways.groupBy("who").applyInArrow(_join_ways, PIECES), "pieces")

    def write(held: pa.Table, decided: pa.Table) -> pa.Table:
        lines = sorted(held.to_pylist(), key=lambda r: r["pos"])
        [way] = decided.to_pylist()
        kept = edited(way["audit"], [(r["role"], r["text"]) for r in lines if not r["absent"]], way["start"])
        out = {"conv": [lines[0]["conv"]], "piece": [way["piece"]], "n_pieces": [way["n_pieces"]], **{n: [way[n]] for n in COUNTS}, "audit": [way["audit"]]}
        types = [pa.field("conv", arrow_kind), *(pa.field(n, pa.int64()) for n in ("piece", "n_pieces", *COUNTS)), pa.field("audit", pa.string()), pa.field("repaired", REPAIRED_ARROW)]
        return pa.table({**out, "repaired": [kept]}, schema=pa.schema(types))

    keys = ("who", "part", "chunk")
    written = loose.select("who", "part", "chunk", "pos", "conv", "role", "text", "absent").groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(
        write, f"conv {kind}, piece bigint, n_pieces bigint, {RESULT}, {REPAIRED}")
    return done.unionByName(written).withColumnRenamed("conv", conv)


def conversation_digests(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation: its counts, cost and whole audit, and ``repaired_sha256`` of its lines ``role:text``.

    Conversations of one piece take no exchange. The pieces of others are read in order by one task each, which keeps a running
    digest and no text.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    rows = pieces.withColumn("lines", lines).withColumn("n", F.size("repaired"))
    single = rows.filter("n_pieces = 1").select(conv, *COUNTS, "audit", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    several = rows.filter("n_pieces > 1").select(key.alias("who"), F.col(conv).alias("conv"), "piece", "n_pieces", *COUNTS, "audit", "lines", "n")
    ordered = several.repartition("who").sortWithinPartitions("who", "piece")
    kind, names = several.schema["conv"].dataType.simpleString(), [*COUNTS, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, sums, audits, any_line = hashlib.sha256(), [0] * len(COUNTS), [], False
        for batch in small_batches(batches, "lines", CHUNK_LETTERS):
            for at, row in enumerate(batch.drop_columns(["conv"]).to_pylist()):
                if row["n"]:
                    digest.update(("\n" if any_line else "").encode() + row["lines"].encode("utf-8", "surrogatepass"))
                    any_line = True
                sums = [s + row[n] for s, n in zip(sums, COUNTS)]
                audits.append(row["audit"])
                if row["piece"] + 1 == row["n_pieces"]:
                    found = [*([s] for s in sums), ["".join(audits)], [digest.hexdigest()]]
                    yield pa.RecordBatch.from_arrays([batch.column("conv").slice(at, 1), *map(pa.array, found)], [conv, *names, "repaired_sha256"])
                    digest, sums, audits, any_line = hashlib.sha256(), [0] * len(COUNTS), [], False

    return single.unionByName(ordered.mapInArrow(run, f"`{conv}` {kind}, {RESULT}, repaired_sha256 string"))
