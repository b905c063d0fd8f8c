"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into ``k`` blocks. Two that differ in at most ``bits`` bits agree on at least ``k - bits`` blocks, so
every choice of that many blocks is a key, and close pairs share at least one of them. Equal fingerprints count once.
Rows meet by key in sorted partitions, where whole distances are verified; large runs return a
spanning forest of their links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import partitions, small_batches, stored, with_small_batches
from goldsieve.llm.graph import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Runs of up to this many fingerprints are compared by offset, all runs at once; longer ones one by one.
SHORT = 12


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text, in order; of all its words when they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    size = min(size, len(words))
    n = len(words) - size + 1
    pieces = zip(starts[:n].tolist(), (starts + lengths)[size - 1:].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pieces), np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of one text as a signed 64-bit number; zero without words."""
    hashes = shingle_hashes(text, size)
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """``id, text_hash, print`` of every row."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            prints = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(prints, pa.int64())], ["id", "text_hash", "print"])

    return with_small_batches(rows).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text_hash bigint, print bigint")


def block_masks(count: int, bits: int) -> list[int]:
    """Masks of every choice of blocks on which a close pair may agree. More fingerprints get longer keys, so that
    chance meetings stay few: keys have about ``64 * (k - bits) / k`` bits."""
    k = bits + 2
    while 64 * (k - bits) / k + 1 < np.log2(max(count, 2)) and k < 2 * bits:
        k += 1
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, k - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's bits


def _forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep what is connected in one run: each is looked for only among those not reached yet."""
    left, a, b = prints, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = distance(left, at) <= bits
            found, left = left[close], left[~close]
            a += [at] * len(found)
            b += found.tolist()
            queue += list(found)
    return np.array(a, np.int64), np.array(b, np.int64)


def links_in_runs(bits: int):
    """Links among the distinct fingerprints of each run of equal ``at, part``; rows arrive sorted by them."""

    def links(at: np.ndarray, part: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        long_row = np.repeat(sizes > SHORT, sizes)
        run = np.cumsum(new)
        a, b = [], []
        for step in range(1, min(SHORT, int(sizes.max()))):
            left = np.flatnonzero((run[:-step] == run[step:]) & ~long_row[:-step])
            left = left[distance(prints[left], prints[left + step]) <= bits]
            a.append(prints[left])
            b.append(prints[left + step])
        for k in np.flatnonzero(sizes > SHORT):
            x, y = _forest(prints[starts[k]:starts[k] + sizes[k]], bits)
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []  # of the last run, which may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "part", "print")])
            if waiting and (rows[:2, -1] == waiting[0][:2, 0]).all():
                waiting.append(rows)
                continue
            rows = np.concatenate([*waiting, rows], axis=1)
            last = int(np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))[-1]) + 1 if (rows[:2] != rows[:2, -1:]).any() else 0
            if last:
                yield from links(*rows[:, :last])
            waiting = [rows[:, last:]]
        if waiting:
            yield from links(*np.concatenate(waiting, axis=1))

    return run


def print_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: links that connect what chains of close fingerprints connect; ``print`` is distinct in ``prints``."""
    masks = block_masks(prints.count(), bits)
    keys = F.array(*(F.struct(F.lit(i).alias("at"), F.col("print").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)))
    spread = prints.select("print", F.explode(keys).alias("k")).select("k.at", "k.part", "print")
    met = spread.repartition(partitions(prints.sparkSession), "at", "part").sortWithinPartitions("at", "part", "print")
    return met.mapInArrow(links_in_runs(bits), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = BITS,
) -> DataFrame:
    """One row per row of ``docs``: ``key, fingerprint`` (16 hex digits), ``component_id``, and ``component, text_hash``.

    Fingerprints link at ``bits`` or fewer differing bits; the component is named by the smallest key that chains of links
    reach (``component`` is its smallest fingerprint, as a number). Texts without words (null, empty, white space) have fingerprint zero and link like any other. Null keys
    never name a component unless all in it are null; repeated keys and rows share theirs. Only ``text``
    and ``key`` are read. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, text, key, size), "prints")
    distinct = stored(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    labels = components(stored(print_links(distinct.select("print"), bits), "links"))
    named = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("label", "print").alias("label")
    )
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.select("print", "label").join(least, "label").select("print", F.col("label").alias("component"), "component_id")
    return rows.join(found, "print").select(
        F.col("id").alias(key), hex_print(F.col("print")).alias("fingerprint"), "component_id", "component", "text_hash",
    )


def keep_best(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` that stay of the components in ``found`` (``id, text_hash, component``): of each the row with
    the smallest key, null keys last, then that with the smallest hash of its text; of rows that repeat key and text any one."""
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("best"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    same = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.text_hash") == F.col("hash"))
    return rows.join(best, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` but for near duplicates; which row of a component stays is ``keep_best``'s law."""
    found = near_duplicates(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "body", "id", size, bits)
    return keep_best(docs, found, text, key)


def hex_print(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
