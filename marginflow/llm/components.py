"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.llm.shared import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on edges ``u, v`` with ``u > v``.

    Large star: every neighbour above a node is linked to the least one of its neighbourhood.
    Small star: every neighbour below, and the node itself, is.  The least neighbour is taken
    before the shuffle, and the join lets adaptive execution split a crowded node.
    """
    seen = edges if small else edges.union(edges.select(F.col("v"), F.col("u")))
    least = seen.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    linked = seen.join(least, F.col("u") == F.col("_u"))
    if small:
        found = linked.filter(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        own = least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
        return found.union(own).distinct()
    least_here = F.least(F.col("u"), F.col("_m"))
    return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), least_here.alias("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges`` (u, v).

    Loops are ignored.  Every round goes to the shared folder; the edges end as stars, after
    a number of rounds that grows with the logarithm of the longest path.
    """
    state = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        mark = state.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        state = written(_star(_star(state, small=False), small=True), "edges")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(state.select("v", "v").distinct())
