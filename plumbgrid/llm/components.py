"""Connected components of a graph given by its edges, and the same within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, scratch


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]. labels[i] <= i leads to the least member; it is flat before and after."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the least node that it is connected with.

    Each round hooks every root to the least root next to it and shortens all paths, until no edge leaves a
    class: the classes that are left at least halve, so rounds grow with the logarithm of the longest path.
    Minima are combined before each shuffle, so a node with very many neighbours is no hot key there; the joins
    on a root are plain equi-joins, which adaptive execution splits where one root has many nodes. Nothing but
    counts reaches the driver.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_components(edges, a, b))


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    n, m = F.greatest(a, b), F.least(a, b)
    open_ = cut_lineage(edges.select(n.alias("x"), m.alias("y")).where("x <> y").distinct(), "edges")
    nodes = open_.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    found = cut_lineage(nodes.select("node", F.col("node").alias("root")), "nodes")
    while not open_.isEmpty():
        # a root hooks to the least root next to it; the new parents are smaller, so there are no cycles
        parent = held = cut_lineage(open_.groupBy("x").agg(F.min("y").alias("p")).select(F.col("x").alias("c"), "p"), "hooks")
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
            longer = cut_lineage(parent.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jumps")
            release(held)
            parent, held = longer.select("c", "p"), longer
            if longer.where("moved").isEmpty():
                break
        before, old = open_, found
        found = cut_lineage(found.join(parent.withColumnRenamed("c", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        ends = open_.join(parent.select(F.col("c").alias("x"), F.col("p").alias("px")), "x", "left").join(parent.select(F.col("c").alias("y"), F.col("p").alias("py")), "y", "left")
        ends = ends.select(F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y")).where("x <> y")
        open_ = cut_lineage(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
        release(before, old, held)
    return found
