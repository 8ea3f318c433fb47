"""Connected components of an edge table, without collecting edges or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiforge.llm.shared import written


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _roots(edges: DataFrame) -> DataFrame:
    """``(node, root)``: every node with a smaller neighbour hangs below the
    smallest one; chains are halved until each node points at its root."""
    trees = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    while True:
        up = trees.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        step = written(trees.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"),
                                                             F.col("_up").isNotNull().alias("_moved")), "roots")
        trees = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return trees


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; the label is the
    smallest node that can be reached.

    Every round hangs each node below its smallest neighbour, finds the roots
    and goes on with the edges between different roots, so the table shrinks by
    rounds.  A root is the smallest node of its tree.  Each table is written, so
    lineage stays short and lost executors cost little; only "is anything left"
    reaches the driver.  Hubs are met by aggregation (map-side minima), never by
    a list of neighbours."""
    first = left = written(_ordered(edges), "edges")
    labels = (first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
              .withColumn("label", F.col("node")))
    while left.limit(1).count():
        roots = _roots(left)
        labels = (labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
                  .select("node", F.coalesce("root", "label").alias("label")))
        for end in ("a", "b"):
            left = (left.join(roots.withColumnRenamed("node", end), end, "left")
                    .withColumn(end, F.coalesce("root", end)).drop("root"))
        left = written(_ordered(left), "edges")
    return written(labels, "components")
