"""Connected components of an edge table, by contraction over checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _through(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """df with the column replaced by its parent where it has one."""
    to = parent.select(F.col("hi").alias("from"), F.col("lo").alias("to"))
    return df.join(to, df[column] == to["from"], "left").withColumn(column, F.coalesce("to", column)).drop("from", "to")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges a, b (long)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    labels = None
    while n := edges.count():
        # every table of a round has so many rows at most; labels grow by them
        parent = cut(edges.groupBy("hi").agg(F.min("lo").alias("lo")), n)
        while True:
            up = parent.select(F.col("hi").alias("from"), F.col("lo").alias("to"))
            jumped = cut(parent.join(up, parent["lo"] == up["from"], "left").select("hi", F.coalesce("to", "lo").alias("lo"), F.col("to").isNotNull().alias("moved")), n)
            parent = jumped.select("hi", "lo")
            if jumped.filter("moved").isEmpty():
                break
        found = parent.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        labels = cut(found, n) if labels is None else cut(_through(labels, "root", parent).unionByName(found))
        moved = _through(_through(edges, "hi", parent), "lo", parent)
        edges = cut(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).filter("hi <> lo").distinct(), n)
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.unionByName(roots)


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root once the edges a, b are added to components (node, root) found before: these are contracted, so few edges cost little."""
    if edges.isEmpty():
        return roots
    up = roots.select(F.col("node").alias("hi"), F.col("root").alias("lo"))
    between = _through(_through(edges.select("a", "b"), "a", up), "b", up)
    more = cut(components(between))
    to = more.select(F.col("node").alias("hi"), F.col("root").alias("lo"))
    moved = _through(roots, "root", to)
    new = more.join(roots.select(F.col("node").alias("its")), F.col("node") == F.col("its"), "left_anti")
    return moved.unionByName(new)
