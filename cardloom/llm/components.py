"""Connected components by alternating large-star and small-star steps, each cut from its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import discard, looked_up, staged


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Edges may repeat, loop or stand in either direction; nulls are dropped. Nothing is collected but one count a round.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = staged(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(low, high).distinct())
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node may have a large part of all edges, so its edges meet its least neighbour without going to one task.
        least = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("w")))
        # large star: larger neighbours of a node link to the least of its neighbourhood
        large = staged(looked_up(both, least, "a", "w").filter("b > a AND m <> b").select(F.col("m").alias("a"), F.col("b")).distinct())
        # small star: a node and its smaller neighbours link to the least of them
        first = staged(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("w")))
        joined = looked_up(large, first, "b", "w")
        after = staged(joined.select(F.col("m").alias("a"), "b").union(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        for spent in (least, large, first):
            discard(spent)
        # Done when no node has two parents and no parent is a child.
        parents, children = after.select("a").distinct(), after.select(F.col("b").alias("a")).distinct()
        left = after.groupBy("b").count().filter("count > 1").select("b").union(parents.join(children, "a", "left_semi")).limit(1).count()
        discard(now)
        now = after
        if not left:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
