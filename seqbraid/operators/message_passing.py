"""Message passing: each string hands its count to its nearest much larger neighbours.

Edges run from a child to parents whose count is at least ``ratio`` times its own;
only the nearest parents count.  Where all of them lead to one canonical string the
child joins it, which a few rounds of joins decide for nearly all strings.  The
others are decided one after another, in uid order, since each decision moves
counts; that happens group by group, over the strings that share a candidate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqbraid.operators.components import connected_components
from seqbraid.plans.shared import materialize


def oriented(pairs: DataFrame, uniq: DataFrame, ratio: float) -> DataFrame:
    """(child, parent, dist): the larger count is the parent; of equal counts the smaller uid."""
    cnt = uniq.select("uid", "cnt")
    joined = pairs.join(cnt.select(F.col("uid").alias("a"), F.col("cnt").alias("ca")), "a").join(cnt.select(F.col("uid").alias("b"), F.col("cnt").alias("cb")), "b")
    kept = joined.where(F.greatest("ca", "cb") >= ratio * F.least("ca", "cb"))
    first = F.col("ca") >= F.col("cb")
    return kept.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("child"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("parent"), "dist")


def direct_parents(edges: DataFrame) -> DataFrame:
    """The edges of each child at its least distance."""
    least = edges.groupBy("child").agg(F.min("dist").alias("dist"))
    return edges.join(least, ["child", "dist"]).select("child", "parent", "dist")


def propagate(uniq: DataFrame, direct: DataFrame) -> DataFrame:
    """(uid, canonical): null where the parents lead to different strings, or to such a one.

    Rounds of joins from the roots down; a round decides every child whose parents
    are decided, so there are as many as the longest chain of parents.
    """
    need = direct.groupBy("child").agg(F.count("*").alias("need"))
    left = need.count()
    state = uniq.select("uid").join(need.select(F.col("child").alias("uid")), "uid", "left_anti").select("uid", F.col("uid").alias("canonical"))
    while left:
        open_ = need.join(state.select(F.col("uid").alias("child")), "child", "left_anti")
        known = direct.join(open_, "child").join(state.withColumnRenamed("uid", "parent"), "parent")
        found = known.groupBy("child", "need").agg(F.count("*").alias("got"), F.count("canonical").alias("sure"), F.min("canonical").alias("low"), F.max("canonical").alias("high"))
        one = (F.col("sure") == F.col("need")) & (F.col("low") == F.col("high"))
        new = materialize(found.where("got = need").select(F.col("child").alias("uid"), F.when(one, F.col("low")).alias("canonical")), "round")
        done = new.count()
        if not done:
            raise ValueError("the parents form a circle")
        left -= done
        state = state.unionByName(new)
    return state


def visiting_order(open_: dict[int, list[int]]) -> list[int]:
    """The keys of (string: parents), each after those of its parents that are keys too, otherwise from the smallest."""
    out: list[int] = []
    begun: set[int] = set()
    for start in sorted(open_):
        path = [] if start in begun else [(start, iter(sorted(open_[start])))]
        begun.add(start)
        while path:
            string, parents = path[-1]
            above = next((p for p in parents if p in open_ and p not in begun), None)
            if above is None:
                out.append(string)
                path.pop()
            else:
                begun.add(above)
                path.append((above, iter(sorted(open_[above]))))
    return out


def preferred(parents: list[int], canonical: dict[int, int], rank: dict[int, tuple[int, int]]) -> int:
    """The string that a child of these parents joins; ``rank``: count and sphere of each string.

    Of the parents that stand for themselves, the one of the greatest rank, if it is
    alone in that; else, of all that the parents stand for, the one of the greatest
    count, the smallest of equal ones.
    """
    roots = {p for p in parents if canonical[p] == p}
    top = max((rank[p] for p in roots), default=None)
    first = [p for p in roots if rank[p] == top]
    if len(first) == 1:
        return first[0]
    return min({canonical[p] for p in parents}, key=lambda c: (-rank[c][0], c))


def resolve(counts: dict[int, int], spheres: dict[int, int], canonical: dict[int, int], parents: dict[int, list[int]]) -> dict[int, int]:
    """``canonical`` with the open strings of a group, the keys of ``parents``; each choice hands its count on at once."""
    rank = {u: (n, spheres.get(u, 0)) for u, n in counts.items()}
    found = dict(canonical)
    for u in visiting_order(parents):
        to = found[u] = preferred(parents[u], found, rank)
        (count, sphere), (own, around) = rank[to], rank[u]
        rank[to], rank[u] = (count + own, sphere + 1), (0, around)
    return found


def _resolve_group(rows: pd.DataFrame) -> pd.DataFrame:
    counts, spheres, canonical, parents = {}, {}, {}, {}
    for r in rows.itertuples():
        counts[r.uid], spheres[r.uid] = int(r.cnt), int(r.sphere)
        if pd.notna(r.canonical):
            canonical[r.uid] = int(r.canonical)
        if r.open:
            parents[r.uid] = sorted(int(p) for p in r.parents)
    todo = sorted(parents)
    found = resolve(counts, spheres, canonical, parents)
    return pd.DataFrame({"uid": pd.Series(todo, dtype="int64"), "canonical": pd.Series([found[u] for u in todo], dtype="int64")})


def message_passing(uniq: DataFrame, pairs: DataFrame, ratio: float = 5.0) -> DataFrame:
    """(uid, canonical) of every record of ``uniq`` (uid, cnt) under ``pairs`` (a, b, dist)."""
    direct = materialize(direct_parents(oriented(pairs, uniq, ratio)), "direct")
    state = materialize(propagate(uniq, direct), "state")
    open_ = state.where("canonical is null").select("uid")
    if open_.isEmpty():
        return state
    # What the first phase leaves: a count moved to each canonical, and a visit for
    # each string it holds and for each child of those.
    fans = direct.groupBy(F.col("parent").alias("uid")).agg(F.count("*").alias("fan"))
    done = state.where("canonical is not null").join(uniq.select("uid", "cnt"), "uid").join(fans, "uid", "left")
    visits = F.sum(F.when(F.col("uid") != F.col("canonical"), 1 + F.coalesce("fan", F.lit(0))).otherwise(0))
    held = done.groupBy("canonical").agg(F.sum("cnt").alias("total"), visits.alias("sphere"))
    around = direct.join(open_.withColumnRenamed("uid", "child"), "child").join(state.withColumnRenamed("uid", "parent"), "parent")
    links = around.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(around.where("canonical is not null").select(F.col("child").alias("a"), F.col("canonical").alias("b")))
    groups = materialize(connected_components(links), "groups")
    lists = around.groupBy(F.col("child").alias("uid")).agg(F.collect_list("parent").alias("parents"))
    nodes = groups.withColumnRenamed("node", "uid").join(state, "uid").join(uniq.select("uid", "cnt"), "uid").join(held.withColumnRenamed("canonical", "uid"), "uid", "left").join(lists, "uid", "left")
    own = F.when(F.col("canonical") == F.col("uid"), F.col("total")).when(F.col("canonical").isNull(), F.col("cnt")).otherwise(0)
    nodes = nodes.select("uid", "component", own.alias("cnt"), F.coalesce("sphere", F.lit(0)).alias("sphere"), "canonical", "parents", F.col("canonical").isNull().alias("open"))
    solved = nodes.groupBy("component").applyInPandas(_resolve_group, "uid long, canonical long")
    return materialize(state.where("canonical is not null").unionByName(solved), "assigned")
