"""Density hierarchy of a spanning tree: condensed clusters and selection by stability.

A cluster needs two members. Going from short to long edges, a single point that joins a cluster adds
to it; two clusters that meet both end and a new one begins above them. A cluster is kept when its
stability is at least that of the best choice below it (excess of mass; Campello et al. 2013). The top
of the whole tree is never kept.

Edges are handled in bands of rising weight. Everything below a band is already summed up in one row per
component, so each task holds one component's edges of one band, never a whole tree.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.forest import spanning_forest
from goldsieve.session import cut_lineage

BAND_ROWS = 2_000_000  # edges of one band: the most a task can get to hold

_STATE = "node bigint, size bigint, lambdas double, below double, cluster string"
_OUT = f"kind string, {_STATE}, parent string, kept boolean"
_NAMES = [c.strip().split(" ")[0] for c in _OUT.split(", ")]


def _lambda(weight: float) -> float:
    return math.inf if weight < 1e-12 else 1.0 / weight


def _close(state: dict, at: float) -> tuple[float, bool]:
    """End a cluster at density ``at``: the value it hands up, and whether it is kept."""
    stability = 0.0 if math.isinf(at) else state["lambdas"] - state["size"] * at
    kept = stability >= state["below"]
    return (stability if kept else state["below"]), kept


def _merge_band(group: pd.DataFrame) -> pd.DataFrame:
    """Merge the components of one group along its edges, shortest first."""
    rows = []
    states = {
        int(r.node): {"size": int(r.size_), "lambdas": r.lambdas, "below": r.below, "cluster": r.cluster}
        for r in group[group["is_state"]].rename(columns={"size": "size_"}).itertuples(index=False)
    }
    top = {n: n for n in states}

    def find(n: int) -> int:
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    edges = group[~group["is_state"]].sort_values(["weight", "a", "b"])
    for e in edges.itertuples(index=False):
        na, nb = find(int(e.na)), find(int(e.nb))
        low, high = min(na, nb), max(na, nb)
        sides = states[na], states[nb]
        density = _lambda(e.weight)
        grown = [s for s in sides if s["cluster"] is not None]
        singles = [(n, s) for n, s in zip((na, nb), sides) if s["cluster"] is None]
        if len(grown) == 1:  # one point falls to the cluster
            merged = dict(grown[0])
            merged["size"] += 1
            merged["lambdas"] += density
        else:  # a new cluster: of two points, or above two clusters that end here
            below = 0.0
            name = f"{int(e.a)}:{int(e.b)}"
            for s in grown:
                value, kept = _close(s, density)
                below += value
                rows.append(("cluster", None, None, None, None, s["cluster"], name, kept))
            size = sides[0]["size"] + sides[1]["size"]
            merged = {"size": size, "lambdas": size * density, "below": below, "cluster": name}
        rows += [("point", n, None, None, None, None, merged["cluster"], None) for n, _ in singles]
        top[high] = low
        states[low] = merged
    for n in top:
        rows.append(("move", n, find(n), None, None, None, None, None))
    for n in {find(n) for n in top}:
        s = states[n]
        rows.append(("state", n, s["size"], s["lambdas"], s["below"], s["cluster"], None, None))
    return pd.DataFrame(rows, columns=_NAMES)


def _top_kept(clusters: DataFrame) -> DataFrame:
    """For every cluster the highest kept cluster above it or itself, by pointer doubling."""
    climb = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("cluster")).alias("top"))
    while True:
        climb = cut_lineage(climb)
        if climb.filter(F.col("up").isNotNull()).isEmpty():
            return climb.select("cluster", "top")
        above = climb.select(F.col("cluster").alias("up"), F.col("up").alias("upper"), F.col("top").alias("higher"))
        climb = climb.join(above, "up", "left").select(
            "cluster", F.col("upper").alias("up"), F.coalesce("higher", "top").alias("top")
        )


def select_clusters(
    points: DataFrame, tree: DataFrame, radius: float | None = None, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``key, label`` for weighted points (``key, copies``) along a spanning tree (``a, b, weight``).

    A label is the smallest key of the cluster, NULL for noise. Several equal copies of a point are a
    cluster from the start. When the tree was cut at ``radius``, what is left of each piece ends there.
    """
    copied = F.col("copies") > 1
    state = points.select(
        F.col("key").alias("node"), F.col("copies").alias("size"),
        F.when(copied, F.lit(math.inf)).otherwise(0.0).alias("lambdas"), F.lit(0.0).alias("below"),
        F.when(copied, F.col("key").cast("string")).alias("cluster"),
    )
    state = cut_lineage(state)
    first = state.filter(F.col("cluster").isNotNull()).select(
        F.lit("point").alias("kind"), "node", F.col("cluster").alias("parent"),
        F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("boolean").alias("kept"),
    )
    links = [first]  # parts of stored bands
    where = points.select("key", F.col("key").alias("node"))
    bands = max(1, math.ceil(tree.count() / band_rows))
    ranged = cut_lineage(
        tree.repartitionByRange(bands, "weight", "a", "b").withColumn("band", F.spark_partition_id())
    )
    for band in range(bands):
        edges = ranged.filter(F.col("band") == band)
        for end, node in (("a", "na"), ("b", "nb")):
            edges = edges.join(where.select(F.col("key").alias(end), F.col("node").alias(node)), end)
        edges = cut_lineage(edges)
        ends = edges.select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.lit(1.0).alias("weight")
        )
        group = spanning_forest(ends)[1].select(F.col("key").alias("node"), F.col("component").alias("grp"))
        group = cut_lineage(group)
        touched = state.join(group, "node").select(
            "grp", F.lit(True).alias("is_state"), "node", "size", "lambdas", "below", "cluster"
        )
        inner = edges.join(group.withColumnRenamed("node", "na"), "na").select(
            "grp", F.lit(False).alias("is_state"), "a", "b", "weight", "na", "nb"
        )
        merged = cut_lineage(
            touched.unionByName(inner, allowMissingColumns=True).groupBy("grp").applyInPandas(_merge_band, _OUT)
        )
        links.append(merged.filter(F.col("kind").isin("point", "cluster")).select(*first.columns))
        state = cut_lineage(
            state.join(group, "node", "left_anti").unionByName(
                merged.filter(F.col("kind") == "state").select(*state.columns)
            )
        )
        if band + 1 < bands:
            moved = merged.filter(F.col("kind") == "move").select("node", F.col("size").alias("_to"))
            where = cut_lineage(
                where.join(moved, "node", "left").select("key", F.coalesce("_to", "node").alias("node"))
            )
    last = state.filter(F.col("cluster").isNotNull())
    if radius is None:
        kept = F.lit(False)
    else:
        kept = (F.col("lambdas") - F.col("size") * _lambda(radius)) >= F.col("below")
    roots = last.select("cluster", F.lit(None).cast("string").alias("parent"), kept.alias("kept"))
    linked = reduce(DataFrame.unionByName, links)
    clusters = linked.filter(F.col("kind") == "cluster").select("cluster", "parent", "kept").unionByName(roots)
    joined = linked.filter(F.col("kind") == "point").select(F.col("node").alias("key"), F.col("parent").alias("cluster"))
    final = joined.join(_top_kept(clusters), "cluster").filter(F.col("top").isNotNull())
    names = final.groupBy("top").agg(F.min("key").alias("label"))
    labeled = final.join(names, "top").select("key", "label")
    alone = F.when(copied, F.col("key"))  # equal copies are a cluster even where nothing else is
    return points.join(labeled, "key", "left").select("key", F.coalesce("label", alone).alias("label"))
