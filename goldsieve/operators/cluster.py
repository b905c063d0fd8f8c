"""Clustering of prompts by vector: components at a distance, and the density hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.operators.forest import LOCAL_LIMIT, spanning_forest
from goldsieve.operators.hierarchy import BAND_ROWS, select_clusters
from goldsieve.operators.similarity import BLOCK_ROWS, chord, near_edges
from goldsieve.fixed import NOISE
from goldsieve.session import cut_lineage


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrow members by fingerprint, distinct vectors with their number of copies)."""
    groups = vectors.groupBy("fingerprint").agg(
        F.min("item_id").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("terms").alias("terms"),
        F.first("weights").alias("weights"), F.first("norm2").alias("norm2"),
    )
    return cut_lineage(vectors.select("item_id", "fingerprint")), cut_lineage(groups)


def components(vectors: DataFrame, cosine: float, block_rows: int = BLOCK_ROWS, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """``item_id, cluster_id``: linked by chains of pairs at least this similar; -1 when alone.

    A cluster is named by its smallest item id; equal vectors always belong together.
    """
    members, groups = _distinct(vectors)
    edges = near_edges(groups, chord(cosine), block_rows)
    _, labels = spanning_forest(edges, local_limit)
    alone = F.col("component").isNull() & (F.col("copies") == 1)
    name = F.when(alone, F.lit(NOISE)).otherwise(F.coalesce("component", "key")).cast("bigint")
    named = groups.select("fingerprint", "key", "copies").join(labels, "key", "left")
    return members.join(named.select("fingerprint", name.alias("cluster_id")), "fingerprint").drop("fingerprint")


def density_clusters(
    vectors: DataFrame, radius: float | None = None, block_rows: int = BLOCK_ROWS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``item_id, cluster_id`` by the density hierarchy with clusters of two or more; -1 is noise.

    The neighbour count behind the core distance is one, so distances stay as they are and the
    hierarchy is that of the minimum spanning tree. Equal vectors collapse to one weighted point.
    Without ``radius`` the whole tree is built; with it, pairs farther apart are never compared.
    """
    members, groups = _distinct(vectors)
    tree, _ = spanning_forest(near_edges(groups, radius, block_rows))
    labels = select_clusters(groups.select("key", "copies"), tree, radius, band_rows)
    named = groups.select("fingerprint", "key").join(labels, "key", "left").select(
        "fingerprint", F.coalesce("label", F.lit(NOISE)).cast("bigint").alias("cluster_id")
    )
    return members.join(named, "fingerprint").drop("fingerprint")
