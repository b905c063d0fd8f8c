"""Connected components by repeated least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``a, b``: the smallest node that can be reached.

    A round gives each node the least label around it, then the label of that label; labels at least double their
    reach, so the rounds grow with the logarithm of the longest shortest path. Edges and labels stay distributed.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().select(F.col("a").alias("node"), F.col("b").alias("other"))
    )
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("around"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("near"))
        upper = labels.select(F.col("node").alias("near"), F.col("label").alias("upper"))
        step = cut_lineage(near.join(upper, "near").select("node", "old", F.least("near", "upper").alias("label")))
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
