"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges, and the number of rounds
grows with the logarithm of the longest path.  The least neighbours are a table of
their own, a row per node, so the join with a hub's edges is dealt like any other
and adaptive skew joins can split it; what an earlier round wrote is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqbraid.plans.shared import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Larger neighbours move to the least one; and the table of the least ones."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smaller neighbours, and the node itself, move to the least one; and the table of the least ones."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), least


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one neighbour, which has no smaller one itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component: its smallest node.

    ``edges`` needs two comparable columns; direction, repeats and self loops
    don't matter (a node with only a self loop is its own component); rows with
    a null end are dropped.  An empty table gives an empty result.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    first = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = first.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now, rounds = first.where("a <> b"), []
    while not _are_stars(now):
        if len(rounds) > max_rounds:
            raise RuntimeError("connected components did not converge")
        large, one = _large_star(now)
        middle = materialize(large, "large_star")
        small, two = _small_star(middle)
        now = materialize(small, "small_star")
        discard(one, two, middle, *rounds[-1:])
        rounds.append(now)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
