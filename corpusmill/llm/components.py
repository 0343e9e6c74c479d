"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import stored

# Beyond log2 of any table's rows; the loop ends when nothing changes.
MAX_ROUNDS = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for the nodes of ``edges``: the smallest node of each one's component.

    Each round gives every node the smallest label beside it and then its label's label, so labels
    cross a component in a number of rounds that grows with the logarithm of its width. Minima
    are combined before their shuffle, so a node with very many edges is no hot group. Each round is a
    written table, which cuts lineage and survives lost executors. Ends are not null; repeated edges count once,
    an edge from a node to itself joins nothing else, and no edges give no rows.
    """
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
                  .union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least"))
                    .select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        beside = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("least")), "other")
                  .groupBy("node").agg(F.min("least").alias("least")))
        nearer = labels.join(beside, "node").select("node", "label", F.least("label", "least").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        moved = stored(nearer.join(above, "next").select("node", F.col("label").alias("was"),
                                                         F.least("next", "above").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label != was").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")
