"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, for edges (a, b).

    Each round takes the least label among a node and its neighbours, then the
    label's own label. Rounds grow with the logarithm of the longest path.
    Every round is written to the shared folder; only the number of changed
    labels comes to the driver. Hot nodes meet joins that split at run time and
    aggregates with map-side partial minima.
    """
    both = shared.materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = shared.materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = least.join(ahead, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = shared.materialise(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
