"""Similarity join: all pairs of strings within an edit distance.

A string is cut into ``most + 1`` even segments.  Strings at distance ``most`` or
less leave one segment of the one intact, at a place in the other that the edits
before and after it can have moved only so far; so the segments of the one meet, by
equality of length class, segment and letters, the substrings of the other at those
places.  Each candidate is verified by the bounded Levenshtein function in the join
itself.  A segment with the wildcard is never intact and isn't indexed.

Segments of a few letters are shared by far too many strings.  Short strings are
therefore halved: of ``most`` edits so many are in the first half and the others in
the second, and a half with edits is halved again, until half of the letters are
known to be intact.  The intact parts together, several for each way that the edits
can fall, are then what meets.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqbraid.functions import strings

#: Strings of fewer letters a segment than this are halved.
SELECTIVE = 12
#: In place of the wildcard in the indexed strings.
_MASK = "\u0001"


def windows(most: int) -> list[tuple[int, int, int]]:
    """(length surplus, segment, shift): where the probing string's substring may stand.

    With ``d`` letters more, segment i of most + 1 starts at most i - 1 edits off
    from the left, and at most + 1 - i off from the right.
    """
    out = []
    for d in range(-most, most + 1):
        for i in range(1, most + 2):
            low, high = max(1 - i, d - (most + 1 - i)), min(i - 1, d + (most + 1 - i))
            out += [(d, i, shift) for shift in range(low, high + 1)]
    return out


def _intact(low: int, high: int, edits: int, at: int, end: int, need: int) -> set[frozenset[tuple[int, int]]]:
    """Sets of (unit, shift), one of which is intact in the units from low to high with so many edits.

    ``at``, ``end``: the shifts before and behind them; ``need``: units that suffice.
    """
    if abs(end - at) > edits:
        return set()
    if need <= 0 or edits and high - low == 1:
        return {frozenset()}
    if not edits:
        return {frozenset((unit, at) for unit in range(low, high))}
    middle, out = (low + high) // 2, set()
    for first in range(edits + 1):
        rest = edits - first
        for shift in range(at - first, at + first + 1):
            if first <= rest:
                out |= {x | y for x in _intact(low, middle, first, at, shift, need) for y in _intact(middle, high, rest, shift, end, need - len(x))}
            else:
                out |= {x | y for y in _intact(middle, high, rest, shift, end, need) for x in _intact(low, middle, first, at, shift, need - len(y))}
    return {x for x in out if not any(y < x for y in out)}


@cache
def halvings(most: int) -> tuple[int, list[list[tuple[int, int]]], list[tuple[int, int, list[tuple[int, int, int]]]]]:
    """Units that a string is cut into; parts to index, as (first, last) units; probes: (length surplus, number of the parts, their first and last units and shifts)."""
    units = 4 if most == 2 else 8

    def runs(parts: frozenset[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for unit, shift in sorted(parts):
            if out and out[-1][1:] == (unit - 1, shift):
                out[-1] = (out[-1][0], unit, shift)
            else:
                out.append((unit, unit, shift))
        return out

    numbers: dict[frozenset[int], int] = {}
    probes = []
    for d in range(-most, most + 1):
        for parts in sorted(_intact(0, units, most, 0, d, units // 2), key=sorted):
            number = numbers.setdefault(frozenset(unit for unit, _ in parts), len(numbers))
            probes.append((d, number, runs(parts)))
    return units, [[r[:2] for r in runs(frozenset((unit, 0) for unit in parts))] for parts in numbers], probes


def _halved(length: Column, most: int) -> Column:
    return length < SELECTIVE * (most + 1) if most in (2, 3) else F.lit(False)


def _segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i; the last ones take what doesn't divide."""
    parts = most + 1
    width = F.floor(length / parts).cast("int")
    plain = F.lit(parts) - length % parts
    start = (i - 1) * width + F.greatest(F.lit(0), i - 1 - plain) + 1
    return start, width + (i > plain).cast("int")


def _structs(rows: list[tuple[int, int, list[tuple[int, int, int]]]], runs: int) -> Column:
    """(d, i, a1, b1, s1, ...) as an array; runs that aren't there are empty."""
    fill = lambda found: [*found, *[(0, -1, 0)] * (runs - len(found))]
    return F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), *(F.lit(v).alias(f"{n}{k}") for k, run in enumerate(fill(found)) for n, v in zip("abs", run, strict=True))) for d, i, found in rows))


def _letters(text: Column, length: Column, units: int, runs: int) -> tuple[Column, Column]:
    """The letters of a row's runs, with the indexed string's length, end to end; whether they stand within the text."""
    parts, inside = [], F.lit(True)
    for k in range(runs):
        start, end = (F.shiftright(length * F.col(f"_w.{n}{k}") + length * extra, units.bit_length() - 1) for n, extra in (("a", 0), ("b", 1)))
        inside &= (end + F.col(f"_w.s{k}") <= F.length(text)) & (start + F.col(f"_w.s{k}") >= 0)
        parts.append(F.substring(text, start + F.col(f"_w.s{k}") + 1, end - start))
    return F.concat(*parts), inside


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", F.xxhash64("_len", "_i", "_seg")).drop("_len", "_i", "_seg")


def _indexed(df: DataFrame, text: str, most: int, wildcard: str | None) -> DataFrame:
    length = F.length(text)
    rows = df.where(~_halved(length, most)).select("*", F.explode(F.sequence(F.lit(1), F.lit(most + 1))).alias("_i"), length.alias("_len"))
    start, size = _segment(F.col("_len"), F.col("_i"), most)
    found = [rows.withColumn("_seg", F.substring(F.col(text), start, size)).withColumn("_once", F.lit(True))]
    if most in (2, 3):
        units, parts, _ = halvings(most)
        half = F.col("_w.i").isin([i for i, p in enumerate(parts) if p in ([(0, units // 2 - 1)], [(units // 2, units - 1)])])
        runs = max(map(len, parts))
        rows = df.where(_halved(length, most)).select("*", F.explode(_structs([(0, i, [(*r, 0) for r in found]) for i, found in enumerate(parts)], runs)).alias("_w"), length.alias("_len"))
        letters, _ = _letters(F.col(text), F.col("_len"), units, runs)
        found.append(rows.select(*df.columns, (-1 - F.col("_w.i")).alias("_i"), "_len", letters.alias("_seg"), half.alias("_once")))
    each = reduce(DataFrame.unionByName, found)
    return _keyed(each.where(~F.col("_seg").contains(_MASK)) if wildcard else each)


def _probes(df: DataFrame, text: str, most: int, surplus: Column) -> DataFrame:
    """``surplus``: whether to look for strings that are ``_w.d`` letters shorter."""
    length, other = F.length(text), F.length(text) - F.col("_w.d")
    table = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in windows(most)))
    rows = df.select("*", F.explode(table).alias("_w")).withColumn("_len", other).where((F.col("_len") >= 0) & ~_halved(F.col("_len"), most) & surplus)
    start, size = _segment(F.col("_len"), F.col("_w.i"), most)
    rows = rows.withColumn("_at", start + F.col("_w.s")).withColumn("_size", size).where((F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= length))
    found = [rows.select(*df.columns, F.col("_w.i").alias("_i"), "_len", F.substring(F.col(text), F.col("_at"), F.col("_size")).alias("_seg"))]
    if most in (2, 3):
        units, _, probes = halvings(most)
        runs = max(len(r) for _, _, r in probes)
        rows = df.where(_halved(length - most, most)).select("*", F.explode(_structs(probes, runs)).alias("_w")).withColumn("_len", other).where((F.col("_len") >= 0) & _halved(F.col("_len"), most) & surplus)
        letters, inside = _letters(F.col(text), F.col("_len"), units, runs)
        found.append(rows.where(inside).select(*df.columns, (-1 - F.col("_w.i")).alias("_i"), "_len", letters.alias("_seg")))
    return _keyed(reduce(DataFrame.unionByName, found))


def _halves_differ(text: str) -> Column:
    """Whether neither half of the indexed string is intact; where one is, it is the half itself that should have met."""
    length = F.length(f"l_{text}")
    half = F.shiftright(length, 1)
    rest = length - half
    return (F.substring(f"l_{text}", F.lit(1), half) != F.substring(f"r_{text}", F.lit(1), half)) & (F.substring(f"l_{text}", half + 1, rest) != F.substring(f"r_{text}", F.length(f"r_{text}") - rest + 1, rest))


def _met(left: DataFrame, right: DataFrame, text: str, most: int, wildcard: str | None, verify: Column, surplus: Column | None = None) -> DataFrame:
    """Verified (l_*, r_*) rows; a pair may come more than once.

    The left strings are indexed, their wildcards masked; left is not longer than
    right in ``text`` unless ``surplus`` says otherwise.  The tables of both sides are many
    times as long as the strings', so neither is broadcast.
    """
    index = _indexed(left, f"l_{text}", most, wildcard)
    probe = _probes(right, f"r_{text}", most, F.col("_w.d") >= 0 if surplus is None else surplus)
    if most in (2, 3):
        verify = (F.col("_once") | _halves_differ(text)) & verify
    return index.hint("merge").join(probe, (index["_key"] == probe["_key"]) & verify)


def _rarer(uniq: DataFrame, text: str, most: int) -> Column:
    """For ``_probes``: of two lengths, the strings of the rarer look for those of the other; the longer of equally rare ones."""
    n = dict(uniq.groupBy(F.length(text)).count().collect())  # at most a row per length
    pick = lambda at, d: at - d in n and (d == 0 or (n[at], -at) < (n[at - d], d - at))
    table = F.array(*(F.array(*(F.lit(at in n and pick(at, d)) for d in range(-most, most + 1))) for at in range(max(filter(None, n), default=0) + 1)))
    return F.element_at(F.element_at(table, F.length(f"r_{text}") + 1), F.col("_w.d") + most + 1)


def _named(df: DataFrame, side: str, columns: list[str], mask: str | None = None) -> DataFrame:
    masked = lambda c: F.translate(c, mask, _MASK) if mask and c.startswith("seq") else F.col(c)
    return df.select(*(masked(c).alias(f"{side}_{c}") for c in columns))


def _verify(most: int, paired: bool) -> Column:
    """The distance of strings, those on the left masked."""
    if paired:
        return strings.pair_distance(F.col("l_seq"), F.col("l_seq2"), F.col("r_seq"), F.col("r_seq2"), most, None)
    return strings.distance(F.col("l_seq"), F.col("r_seq"), most, None)


def _bounds(most: int, paired: bool) -> list[tuple[str, int]]:
    """Columns to look for candidates in, and how far apart they may be there.

    Of mates within ``most`` together, the first are within half of it, or the second
    within what is left less one.
    """
    half = most // 2
    return [("seq", half), ("seq2", most - half - 1)] if paired else [("seq", most)]


def similar_pairs(uniq: DataFrame, most: int, wildcard: str | None = "N", paired: bool = False, ratio: float | None = None, method: str = "segments") -> DataFrame:
    """(a, b, dist): all pairs of distinct records with distance 1 to ``most``, a < b by uid.

    ``uniq``: uid, seq, cnt (and seq2 if ``paired``).  With ``ratio``, only pairs
    whose larger count is at least ``ratio`` times the smaller, tested before the
    distance.  ``method``: segments, or nested for a join of every pair, to compare.
    """
    if not 0 <= most <= strings.MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {strings.MAX_DISTANCE}")
    columns = ["uid", "seq", "cnt"] + ["seq2"] * paired
    left, right = _named(uniq, "l", columns, wildcard), _named(uniq, "r", columns)
    check = F.col("l_uid") != F.col("r_uid")
    if ratio is not None:
        check &= F.greatest("l_cnt", "r_cnt") >= ratio * F.least("l_cnt", "r_cnt")
    dist = _verify(most, paired)
    if method == "nested":
        found = left.join(right, (F.col("l_uid") < F.col("r_uid")) & check & (dist >= 0))
    elif method == "segments":
        # Strings of the same length meet both ways round.
        once = lambda c: check & ((F.length(f"l_{c}") != F.length(f"r_{c}")) | (F.col("l_uid") < F.col("r_uid"))) & (dist >= 0)
        found = reduce(DataFrame.unionByName, [_met(left, right, c, k, wildcard, once(c), _rarer(uniq, c, k)).select(*left.columns, *right.columns) for c, k in _bounds(most, paired) if k >= 0])
    else:
        raise ValueError(f"unknown method {method!r}")
    a, b = F.least("l_uid", "r_uid").alias("a"), F.greatest("l_uid", "r_uid").alias("b")
    return found.select(a, b, dist.alias("dist")).distinct().where("dist > 0")


def pairs_against(queries: DataFrame, targets: DataFrame, most: int, wildcard: str | None = "N") -> DataFrame:
    """(query, target, dist): all targets within ``most`` of each query; both have uid and seq."""
    check = _verify(most, False)
    q, t = _named(queries, "l", ["uid", "seq"], wildcard), _named(targets, "r", ["uid", "seq"])
    short = _met(q, t, "seq", most, wildcard, check >= 0).select("l_uid", "r_uid", check.alias("dist"))
    # The other way round the query is the longer; its wildcards still match nothing.
    q2, t2 = _named(queries, "r", ["uid", "seq"]), _named(targets, "l", ["uid", "seq"], wildcard)
    long = _met(t2, q2, "seq", most, wildcard, check >= 0).select(F.col("r_uid").alias("l_uid"), F.col("l_uid").alias("r_uid"), check.alias("dist"))
    return short.unionByName(long).distinct().select(F.col("l_uid").alias("query"), F.col("r_uid").alias("target"), "dist")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b, dist) with each pair on both its ends."""
    return pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
