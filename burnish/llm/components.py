"""Connected components of links between nodes, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) between nodes, undirected: node and label, the same label for all nodes of a component.

    Each round hooks every node to its smallest neighbour, if that is smaller than itself, and contracts the links to
    those between different labels. Where node numbers are hashes, a round leaves a fraction of the nodes. Nodes
    without links are not in the result. Null ends are dropped.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = settle(both.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    labels = settle(left.select(F.col("high").alias("node")).union(left.select("low")).distinct().withColumn("label", F.col("node")))
    while not left.isEmpty():
        hooks = settle(left.groupBy("high").agg(F.min("low").alias("to")).withColumnRenamed("high", "from"))
        moved = lambda df, name: (
            df.join(hooks, F.col(name) == F.col("from"), "left").withColumn(name, F.coalesce("to", name)).drop("from", "to")
        )
        labels = settle(moved(labels, "label"))
        ends = moved(moved(left, "high"), "low").where("high <> low")
        left = settle(ends.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct())
    return labels
