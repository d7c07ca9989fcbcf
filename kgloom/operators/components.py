"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); a component is named by its smallest node.

    Each round hangs every node under its smallest neighbour (if smaller), finds the roots by pointer doubling, and
    contracts the edges to edges between roots, until none is left: a logarithmic number of rounds for any shape.
    ``store`` must cut the lineage of a table at durable files; it is called once for each step.  Loops and
    repeated edges are allowed, edges with a null end are dropped.
    """
    edges = store(edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("component"))
    edges = edges.where("src < dst")
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        parents = store(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = store(parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        top = parents.select(F.col("node").alias("component"), "root")
        labels = store(labels.join(top, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        src, dst = parents.select(F.col("node").alias("src"), F.col("root").alias("a")), parents.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        moved = edges.join(src, "src").join(dst, "dst").where("a <> b")
        edges = store(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    return labels
