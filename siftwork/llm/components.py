"""Connected components by rounds of contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(work: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component share a root of it.

    In each round a node hooks to its least neighbour, where that is less, and edges are drawn
    between what they hook to, until none is left between different nodes.
    """
    left = work.table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = work.table(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y")), "hooks")
        for _ in range(2):  # pointers to pointers
            up = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            hook = hook.join(up, "y").select("x", F.col("z").alias("y"))
        hook = work.table(hook, "hooks")
        if roots is None:
            roots = hook.select(F.col("x").alias("node"), F.col("y").alias("root"))
        else:
            roots = work.table(roots.join(hook.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("y", "root").alias("root")), "roots")
        a, b = hook.select(F.col("x").alias("a"), F.col("y").alias("ra")), hook.select(F.col("x").alias("b"), F.col("y").alias("rb"))
        drawn = left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = work.table(drawn, "edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
