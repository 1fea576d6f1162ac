"""Greedy spheres: the largest strings claim their neighbours, and nearer ones steal them.

Strings are visited by count, then by their neighbours' counts, then uid.  One that
no centre has claimed becomes a centre itself; so a string is a centre just if none
of its neighbours that come before it is one.  That is decided in rounds of joins:
whoever has no undecided neighbour before it is a centre, and its neighbours are
not.  In the end each of them belongs to its nearest centre, the first visited of
equally near ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqbraid.operators.components import connected_components
from seqbraid.operators.pairs import both_ways
from seqbraid.plans.shared import discard, materialize


def neighbour_weight(uniq: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, weight, degree): the neighbours' counts together, and how many there are."""
    cnt = uniq.select(F.col("uid").alias("b"), "cnt")
    return both_ways(pairs).join(cnt, "b").groupBy(F.col("a").alias("uid")).agg(F.sum("cnt").alias("weight"), F.count("*").alias("degree"))


def centres(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid) of the centres among ``nodes`` (uid); ``edges`` (first, then): neighbours in visiting order."""
    found, open_, left = None, materialize(nodes.select("uid"), "open"), materialize(edges.select("first", "then"), "edges")
    while True:
        new = open_.join(left.select(F.col("then").alias("uid")), "uid", "left_anti").withColumn("centre", F.lit(True))
        claimed = left.join(new.select(F.col("uid").alias("first")), "first", "left_semi").select(F.col("then").alias("uid")).distinct().withColumn("centre", F.lit(False))
        decided = materialize(new.unionByName(claimed), "decided")
        mine = decided.where("centre").select("uid")
        found = mine if found is None else found.unionByName(mine)
        gone = decided.select("uid")
        rest = materialize(open_.join(gone, "uid", "left_anti"), "open")
        fewer = left.join(gone.withColumnRenamed("uid", "first"), "first", "left_anti").join(gone.withColumnRenamed("uid", "then"), "then", "left_anti")
        fewer = materialize(fewer.select("first", "then"), "edges")
        discard(open_, left)
        open_, left = rest, fewer
        if open_.isEmpty():
            return found


def spheres(uniq: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, canonical) of every record (uid, cnt); strings without a neighbour are their own centres."""
    weight = neighbour_weight(uniq, pairs).select("uid", "weight")
    rank = materialize(uniq.select("uid", "cnt").join(weight, "uid").select("uid", F.struct(-F.col("cnt"), -F.col("weight"), "uid").alias("rank")), "visits")
    one, two = rank.select(F.col("uid").alias("a"), F.col("rank").alias("ra")), rank.select(F.col("uid").alias("b"), F.col("rank").alias("rb"))
    near = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "dist", "ra", "rb"), "neighbours")
    before = F.col("ra") < F.col("rb")
    ordered = near.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("then"))
    centre = materialize(centres(rank, ordered), "centres")
    ends = near.select(F.col("a").alias("uid"), F.col("b").alias("near"), "dist", F.col("rb").alias("rank")).unionByName(near.select(F.col("b").alias("uid"), F.col("a").alias("near"), "dist", F.col("ra").alias("rank")))
    claims = ends.join(centre.withColumnRenamed("uid", "near"), "near", "left_semi").join(centre, "uid", "left_anti")
    held = claims.groupBy("uid").agg(F.min_by("near", F.struct("dist", "rank")).alias("canonical"))
    own = uniq.select("uid").join(held.select("uid"), "uid", "left_anti").select("uid", F.col("uid").alias("canonical"))
    return materialize(held.unionByName(own), "assigned")


def components(uniq: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, canonical): connected components, each named by its string of the largest count, then degree, then smallest uid."""
    groups = connected_components(pairs).withColumnRenamed("node", "uid")
    nodes = uniq.select("uid", "cnt").join(groups, "uid", "left").join(neighbour_weight(uniq, pairs).select("uid", "degree"), "uid", "left")
    nodes = materialize(nodes.select("uid", "cnt", F.coalesce("component", "uid").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
    best = nodes.groupBy("component").agg(F.max_by("uid", F.struct("cnt", "degree", -F.col("uid"))).alias("canonical"))
    return nodes.join(best, "component").select("uid", "canonical")
