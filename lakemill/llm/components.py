"""Connected components by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: each node ``a`` and its other ``b`` point at the smallest of them.

    Nodes that name many roots in common (a large group compared tile by tile) then keep one edge each, and the
    roots one. ``a`` is the side with few different ``b``: as many as a class has bands or a group has tiles.
    """
    grouped = edges.filter("a <> b").groupBy("a").agg(F.collect_set("b").alias("ends"))
    least = grouped.select("a", "ends", F.least("a", F.array_min("ends")).alias("least"))
    pointing = least.select(F.explode(F.array_append("ends", F.col("a"))).alias("a"), F.col("least").alias("b"))
    return pointing.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the label is the smallest node that can be reached.

    Edges are contracted first. Each round takes the smallest label of the neighbours, summed before the
    shuffle, and then the label of the label; rounds go on until none changes.
    """
    #: Both directions of an edge come from one evaluation of it, since a second one may name other edges.
    directions = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = settle(contracted(edges).select(directions.alias("e")).select("e.a", "e.b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("lower"))
        lower = settle(lower)
        step = lower.select(F.col("node").alias("at"), F.col("lower").alias("jump"))
        jumped = settle(lower.join(step, lower["lower"] == step["at"]).select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved")))
        labels = jumped.select("node", "label")
        if not jumped.filter("moved").limit(1).count():
            return labels
