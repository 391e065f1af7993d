"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, keep) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), both of type long.

    Each round gives a node the smallest of itself and its neighbours, replaces
    the ends of all edges by that and drops loops; the nodes left at least halve.
    Rounds are composed afterwards.  ``keep`` writes a table and ends lineage.
    """
    rounds = []
    live = keep(edges.filter("a != b").select("a", "b"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        )
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(left, "a").join(right, "b").filter("ra != rb")
        live = keep(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("final"))
        out = step.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return out
