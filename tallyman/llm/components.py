"""Connected components of a graph that no task or driver holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the links ``a, b``.

    Each round gives a node the smallest label among its neighbours' and then its
    label's own label, so paths halve. Rounds read and write tables in the shared
    folder, which cuts the lineage. A node with very many links only ever takes
    part in a minimum, which is combined on the map side, and in a plain join."""
    links = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        lowest = both.join(of_b, "b").groupBy("a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "node")
        hooked = labels.join(lowest, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = hooked.join(of_label, "component", "left").select("node", "old", F.least("component", "further").alias("component"))
        labels = stored(jumped, "labels")
        if labels.where(F.col("old") != F.col("component")).isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
