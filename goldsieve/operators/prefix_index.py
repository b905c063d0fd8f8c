"""Which blocks of vectors a vector must meet so that no pair above a cosine is missed: an inverted index over rare terms.

Terms are ordered by rarity over all vectors. On the unit sphere two vectors have a dot product of at most the product of
what is left of their lengths from their first common term on. So a pair above the threshold shares a term among those of
either where more than the threshold is left: its prefix. Postings of prefix terms are joined with the terms of blocks;
postings of frequent terms are split. A vector then shows its prefix, no more, to the blocks found, where the exact dot
product of the prefix plus the product of both remaining lengths bounds each cosine; only what passes is worth a visit.
Nothing is capped, and no pairs are returned: a row says that a vector has to visit a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.session import cut_lineage

#: Vectors of a frequent term that go to one task of the join with blocks.
_SLICE_ROWS = 4096
#: Widens bounds by more than what rounding in single precision takes from them.
_SLACK = 1e-4
#: Document frequencies at which what is left of a vector is tabled; between them the bound is that of the lower.
_STEPS = np.unique(np.floor(2.0 ** (np.arange(0, 129) / 4.0))).astype(np.int64)

RANKED = (
    "key bigint, terms array<bigint>, weights array<double>, dfs array<bigint>, left array<double>, rest double, stop bigint"
)


def ranked(vectors: DataFrame, threshold: float) -> DataFrame:
    """Unit vectors with their terms from rare to frequent.

    ``left`` has the length from each term of the prefix on, ``rest`` that of what follows the prefix, ``stop`` the frequency of
    the first term after it. Zero vectors are left out.
    """
    terms = vectors.filter("norm2 > 0").select("key", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select("key", "e.*")
    seen = terms.groupBy("terms").agg(F.count(F.lit(1)).alias("df"))
    entries = F.sort_array(F.collect_list(F.struct("df", F.col("terms").alias("term"), F.col("weights").alias("weight"))))
    rows = terms.join(seen, "terms").groupBy("key").agg(entries.alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("e")
            at = lists.offsets.to_numpy().astype(np.int64)
            at -= at[0]
            entries = lists.flatten()
            df, term, weight = (entries.field(n).to_numpy(zero_copy_only=False) for n in ("df", "term", "weight"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            share = weight * weight
            total = np.add.reduceat(share, at[:-1])
            unit = weight / np.sqrt(total)[row]
            before = np.cumsum(share) - share
            left = np.sqrt(np.maximum(1.0 - (before - before[at[:-1]][row]) / total[row], 0.0))
            inside = left > threshold - _SLACK
            size = np.add.reduceat(inside.astype(np.int64), at[:-1])  # prefixes are where ``left`` is large: at the start
            end = at[:-1] + size
            whole = end == at[1:]
            safe = np.minimum(end, len(left) - 1)
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(unit)),
                pa.ListArray.from_arrays(offsets, pa.array(df)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(left[inside])),
                pa.array(np.where(whole, 0.0, left[safe])), pa.array(np.where(whole, np.iinfo(np.int64).max, df[safe])),
            ], ["key", "terms", "weights", "dfs", "left", "rest", "stop"])

    return rows.mapInArrow(run, RANKED)


def _addresses(placed: DataFrame, threshold: float) -> DataFrame:
    """(key, cell, part) of every foreign block that shares a prefix term with a vector where the lengths left allow a pair."""
    size = F.size("left")
    prefix = F.explode(F.arrays_zip(F.slice("terms", F.lit(1), size).alias("term"), F.slice("dfs", F.lit(1), size).alias("df"), "left"))
    postings = placed.select("key", "cell", "part", prefix.alias("p")).select("key", "cell", "part", "p.*").filter("df > 1")
    slices = F.floor(F.col("df") / _SLICE_ROWS) + 1
    blocks = postings.groupBy("cell", "part", "term", "df").agg(F.max("left").alias("most")).select(
        F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), "term", "most",
        F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"),
    )
    asking = postings.withColumn("slice", F.pmod(F.xxhash64("key"), slices))
    foreign = (F.col("cell") != F.col("to_cell")) | (F.col("part") != F.col("to_part"))
    met = asking.join(blocks, ["term", "slice"]).filter(foreign & (F.col("left") * F.col("most") > threshold - _SLACK))
    return met.select("key", "to_cell", "to_part").distinct()


def _screen(threshold: float, dots: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]):
    """Which callers, shown by their prefixes, may be above the threshold with a vector of the block."""

    def kernel(block: pd.DataFrame, callers: pd.DataFrame | None) -> pd.DataFrame:
        if callers is None or not len(block):
            return pd.DataFrame({"key": [], "cell": [], "part": [], "pairs": []})
        dfs = np.concatenate(block["dfs"].tolist())
        weight = np.concatenate(block["weights"].tolist())
        row = np.repeat(np.arange(len(block)), [len(x) for x in block["dfs"]])
        step = np.searchsorted(_STEPS, dfs, "right") - 1
        share = np.bincount(row * len(_STEPS) + step, weight * weight, minlength=len(block) * len(_STEPS)).reshape(len(block), -1)
        after = np.sqrt(np.maximum(share[:, ::-1].cumsum(axis=1)[:, ::-1], 0.0))  # length in terms at least as frequent as a step
        shared = dots(callers, block)
        stop = np.searchsorted(_STEPS, callers["stop"].to_numpy(), "right") - 1
        may = (shared > 0) & (shared + callers["rest"].to_numpy()[:, None] * after[:, stop].T > threshold - _SLACK)
        found = may.any(axis=1)
        return pd.DataFrame({
            "key": callers["key"].to_numpy()[found], "cell": block["cell"].iloc[0], "part": block["part"].iloc[0], "pairs": may.sum(axis=1)[found],
        })

    return kernel


def visits(placed: DataFrame, threshold: float, gather, dots) -> DataFrame:
    """``key, to_cell, to_part, pairs``: the foreign blocks a vector must meet, and with how many vectors of each its
    cosine is not ruled out. ``placed`` are vectors with their own ``cell`` and ``part``."""
    homes = placed.select("key", "cell", "part")
    ordered = cut_lineage(ranked(placed.select("key", "terms", "weights", "norm2"), threshold).join(homes, "key"))
    going = cut_lineage(_addresses(ordered, threshold))
    hosts = ordered.select("key", "terms", "weights", "dfs", "rest", "stop", F.lit(1.0).alias("norm2"), "cell", "part")
    size = F.size("left")
    guests = ordered.select(
        "key", F.slice("terms", F.lit(1), size).alias("terms"), F.slice("weights", F.lit(1), size).alias("weights"),
        F.lit(None).cast("array<bigint>").alias("dfs"), "rest", "stop", F.lit(1.0).alias("norm2"),
    )
    found = gather(hosts, guests, going, _screen(threshold, dots), "key bigint, cell int, part int, pairs bigint")
    return cut_lineage(found.withColumnsRenamed({"cell": "to_cell", "part": "to_part"}))
