"""Dense vectors from token counts: the leading directions of the document-term matrix by randomised range finding.

The matrix (one row of unit length a document) is never put together. Multiplying it by a random matrix, whose rows follow from
hashes of the terms, gives a tall thin one; rounds of multiplying back and forth sharpen it, each in one pass over blocks of
documents. Tall matrices are stored tables with an array a row; only their Gram matrices, a few dozen numbers square, meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.sign_projection import planes
from goldsieve.session import cut_lineage, release

#: Length of a vector, directions beyond it that are carried along, and rounds of sharpening.
RANK, MORE, ROUNDS = 16, 8, 2
#: Entries of the matrix in a block of rows, and the least that are worth a block to keep a core busy. Larger blocks send fewer rows of
#: numbers, as more of their entries share a term. The rows of one key are never parted.
BLOCK_ENTRIES, LEAST_ENTRIES = 4_000_000, 250_000
#: What a row of a round's sums is about: a term, a key, or a line of the Gram matrix.
_TERM, _KEY, _GRAM = 0, 1, 2


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, flat values) of a list column."""
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.flatten().to_numpy(zero_copy_only=False)


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    return _lists(column)[1].reshape(-1, width)


def _array(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _gram(tall: DataFrame, column: str, width: int) -> np.ndarray:
    """The products of all columns with each other, added up by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _rows(batch.column(column), width)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    found = tall.select(column).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in found:
        out[r["at"]] = r.x
    return out.reshape(width, width)


def _times(tall: DataFrame, column: str, square: np.ndarray) -> DataFrame:
    """The rows times a small matrix known to all tasks; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.set_column(batch.schema.get_field_index(column), column, _array(_rows(batch.column(column), len(square)) @ square))

    return tall.mapInArrow(run, tall.schema)


def _turn(gram: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; directions without weight become zero."""
    values, turned = np.linalg.eigh(gram)
    keep = values > values.max(initial=0.0) * 1e-12
    return turned * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _orthonormal(tall: DataFrame, column: str, width: int) -> DataFrame:
    """The same span with columns at right angles and of length one. Not stored: it is made from stored rows by a small matrix."""
    return _times(tall, column, _turn(_gram(tall, column, width)))


def _products(rows: pa.Table, known: np.ndarray, place: np.ndarray, by_term: np.ndarray, first: bool) -> pa.Table:
    """What a block adds to the sums of a round: the matrix times ``by_term``, that times the transposed matrix, and the Gram matrix
    of the former. Rows that share a key are one row, their sum; in the first round the Gram matrix is that of the rows apart."""
    width = by_term.shape[1]
    at, weights = _lists(rows.column("weights").combine_chunks())
    row = np.repeat(np.arange(rows.num_rows), np.diff(at))
    unit = weights / np.sqrt(rows.column("norm2").to_numpy())[row]
    apart = np.column_stack([np.bincount(row, unit * by_term[place, i], rows.num_rows) for i in range(width)])
    with_key = rows.column("key").is_valid().to_numpy(zero_copy_only=False)
    keys, of = np.unique(rows.column("key").drop_null().to_numpy(), return_inverse=True)
    y = np.column_stack([np.bincount(of, apart[with_key, i], len(keys)) for i in range(width)])
    shared = np.zeros_like(apart)
    shared[with_key] = y[of]
    z = np.column_stack([np.bincount(place, unit * shared[row, i], len(known)) for i in range(width)])
    told = apart if first else y
    ids = np.concatenate([known, keys, np.arange(width)]).astype(np.int64)
    kind = np.repeat(np.array([_TERM, _KEY, _GRAM], np.int32), [len(known), len(keys), width])
    numbers = np.concatenate([z, y, told.T @ told])
    names = [f"z{i}" for i in range(width)]
    block = np.full(len(ids), rows.column("block")[0].as_py(), np.int32)
    return pa.table([pa.array(kind), pa.array(ids), pa.array(block), *(pa.array(numbers[:, i]) for i in range(width))], ["kind", "id", "block", *names])


def _vocabulary(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a block in order, and the place of each entry's term among them."""
    return np.unique(_lists(rows.column("terms").combine_chunks())[1], return_inverse=True)


def _round(blocked: DataFrame, by_term: DataFrame | None, width: int) -> DataFrame:
    """``kind, id, z, blocks``: the sums of :func:`_products` over all blocks, and for terms the blocks that hold them.

    A block gets a row of ``by_term`` once for each of its distinct terms and gives one back; entries do not travel with rows of
    numbers. Without ``by_term`` the rows follow from hashes of the terms.
    """
    names = [f"z{i}" for i in range(width)]
    schema = ", ".join(["kind int", "id bigint", "block int", *(f"{n} double" for n in names)])

    def start(rows: pa.Table) -> pa.Table:
        known, place = _vocabulary(rows)
        return _products(rows, known, place, planes(known, width).astype(np.float64), True)

    def further(rows: pa.Table, given: pa.Table) -> pa.Table:
        if rows.num_rows == 0:  # its rows have no key
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int32()), *[pa.array([], pa.float64())] * width], ["kind", "id", "block", *names])
        known, place = _vocabulary(rows)
        order = np.argsort(given.column("id").to_numpy())
        held = np.searchsorted(given.column("id").to_numpy()[order], known)
        return _products(rows, known, place, _rows(given.column("z").combine_chunks(), width)[order[held]], False)

    if by_term is None:
        parts = blocked.groupBy("block").applyInArrow(start, schema)
    else:
        given = by_term.select(F.explode("blocks").alias("block"), "id", "z")
        parts = blocked.filter("key is not null").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(further, schema)
    sums = parts.groupBy("kind", "id").agg(*(F.sum(n).alias(n) for n in names), F.collect_list(F.when(F.col("kind") == _TERM, F.col("block"))).alias("blocks"))
    return cut_lineage(sums.select("kind", "id", F.array(*names).alias("z"), "blocks"))


def _gram_of(found: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for r in found.filter(F.col("kind") == _GRAM).collect():
        out[r.id] = r.z
    return out


def lsa_vectors(vectors: DataFrame, key: str, rank: int = RANK, more: int = MORE, rounds: int = ROUNDS) -> DataFrame:
    """``key, vector``: an array of ``rank`` numbers for every row, zeros for a row without tokens.

    ``vectors`` have a whole-number ``key`` and token vectors. All rows and terms are used. Columns come from the largest singular
    value down; signs are fixed by the small matrix that turns them. Ranks beyond that of the matrix give zeros.
    """
    width = rank + more
    # Stored first: used inside expressions, parts of a vector would be worked out, text and all, again and again.
    rows = cut_lineage(vectors.select(F.col(key).cast("bigint").alias("key"), "terms", "weights", "norm2")).filter("norm2 > 0")
    entries = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    spot = F.when(F.col("key").isNull(), F.xxhash64("terms")).otherwise(F.xxhash64("key"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-entries // BLOCK_ENTRIES), min(cores, -(-entries // LEAST_ENTRIES)), 1)
    blocked = rows.withColumn("block", F.pmod(spot, F.lit(blocks)).cast("int"))

    found = _round(blocked, None, width)
    for _ in range(rounds):
        by_term = _times(found.filter(F.col("kind") == _TERM).select("id", "z", "blocks"), "z", _turn(_gram_of(found, width)))
        older, found = found, _round(blocked, _orthonormal(by_term, "z", width), width)
        release(older)
    straight = _turn(_gram_of(found, width))
    values, turned = np.linalg.eigh(_gram(_times(found.filter(F.col("kind") == _TERM).select("id", "z"), "z", straight), "z", width))
    order = np.argsort(-values, kind="stable")[:rank]
    turned, values = turned[:, order], np.maximum(values[order], 0.0)
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(rank)])
    tall = found.filter(F.col("kind") == _KEY).select(F.col("id").alias("key"), F.col("z").alias("y"))
    found = _times(tall, "y", straight @ (turned * np.sqrt(values)))
    return vectors.select(F.col(key).cast("bigint").alias("key")).join(found, "key", "left").select(
        F.col("key").alias(key), F.coalesce("y", F.array_repeat(F.lit(0.0), rank)).alias("vector"))
