"""Connected components by repeated contraction, with staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (its smallest node) for every node with an edge; staged.

    Each round hooks every node to the smallest of its neighbours and itself, follows two
    hooks, and contracts the edges; the number of nodes with edges falls by half at
    least, so rounds grow with the logarithm of a component's size, and a star needs one.

    Defined results: edges with a null end or from a node to itself are no edges;
    repeated edges count once; an empty table gives no rows; other columns are ignored.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    mapping, held = None, []
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        for _ in range(2):
            far = hook.select(F.col("node").alias("p"), F.col("p").alias("q"))
            hook = hook.join(far, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        hook = stage(hook, "cc-hooks")
        if mapping is None:
            mapping = hook.withColumnRenamed("p", "component")
            mapping.staged_path = hook.staged_path
        else:
            step = hook.select(F.col("node").alias("component"), F.col("p").alias("_next"))
            merged = mapping.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
            held += [mapping, hook]
            mapping = stage(merged, "cc-map")
        left = hook.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        edges = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        unstage(*held)
        held = [edges]
        if edges.isEmpty():
            unstage(edges)
            return mapping
