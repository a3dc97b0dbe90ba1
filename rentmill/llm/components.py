"""Connected components of a table of links, by hooking and pointer jumping.

Every node hooks onto its smallest smaller neighbour, which gives a forest; pointers are doubled until each names its
root; links between different roots go into the next round. No node's links are ever gathered: a hub costs a
map-side combined minimum and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of ``links`` (a, b; a < b), the smallest node it is connected with. Nodes that are
    their own root are left out."""
    labels = None
    while True:
        forest = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        while True:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            forest = forest.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
            forest = materialise(forest, "forest")
            moved = forest.where("moved").limit(1).count()
            forest = forest.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = forest
        else:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            old = labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            labels = materialise(old.unionByName(forest.join(labels, "node", "left_anti")), "labels")
        links = between(links, forest)
        links = materialise(links.select("left", "right").toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return labels


def between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``links`` whose ends have different roots, with these as ``left`` and ``right``."""
    for end, name in (("a", "left"), ("b", "right")):
        root = labels.select(F.col("node").alias(end), F.col("root").alias(name))
        links = links.join(root, end, "left").withColumn(name, F.coalesce(name, end))
    return links.where(F.col("left") != F.col("right"))
