"""Connected components of a graph given as edges, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the least node of its component.

    Each round takes the least label of a node and its neighbours, then follows labels once, so the
    rounds grow with the logarithm of the components' extent. Every round is written to the shared
    folder; no component is gathered anywhere, and a node's neighbours are reduced before the shuffle.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        now = labels.select("node", "label")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = written(low.join(jump, "label", "left").select("node", F.least(F.col("label"), F.coalesce("root", "label")).alias("label"), "before"))
        drop(labels)
        labels = after
        if after.where("label <> before").isEmpty():
            drop(both)
            return after.select("node", "label")
