"""The engine's front: cluster reads, then look at the result in any layout."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seqbraid.functions import strings
from seqbraid.operators import collapse, message_passing, pairs as similarity, spheres, umi
from seqbraid.plans import ship
from seqbraid.plans.shared import materialize
from seqbraid.sources import reads as sources

ALGORITHMS = ("mp", "spheres", "components")


@dataclass
class Clustering:
    """Reads, distinct records, pairs and the record each belongs to."""

    reads: DataFrame
    uniq: DataFrame
    pairs: DataFrame
    assigned: DataFrame  # uid, canonical
    distance: int

    def _members(self) -> DataFrame:
        names = self.uniq.select(F.col("uid").alias("canonical"), strings.shown(F.col("seq"), F.col("seq2")).alias("canonical_name"))
        return self.uniq.withColumn("name", strings.shown(F.col("seq"), F.col("seq2"))).join(self.assigned, "uid").join(names, "canonical")

    def clusters(self, ids: bool = False) -> DataFrame:
        """(canonical, size, n_unique, members[, read_ids]), a row per cluster; members in alphabetical order."""
        grouped = self._members().groupBy(F.col("canonical_name").alias("canonical"))
        found = grouped.agg(F.sum("cnt").alias("size"), F.count("*").alias("n_unique"), F.sort_array(F.collect_list("name")).alias("members"))
        if not ids:
            return found
        gathered = self.tidy().groupBy("canonical").agg(F.sort_array(F.collect_list("read_id")).alias("read_ids"))
        return found.join(gathered, "canonical")

    def sizes(self) -> DataFrame:
        """(canonical, size) without lists, which a large cluster would make long."""
        return self._members().groupBy(F.col("canonical_name").alias("canonical")).agg(F.sum("cnt").alias("size"))

    def tidy(self) -> DataFrame:
        """(read_id, seq, canonical): each record with its canonical string."""
        named = self._members().select("seq", "seq2", "name", "canonical_name")
        same = [self.reads[c].eqNullSafe(named[c]) for c in ("seq", "seq2")]
        return self.reads.join(named, same).select("read_id", F.col("name").alias("seq"), F.col("canonical_name").alias("canonical"))

    def non_redundant(self) -> DataFrame:
        """The canonical records: canonical, size, seq, seq2 and what was read with them."""
        info = [c for c in collapse.INFO if c in self.uniq.columns]
        chosen = self.assigned.where("uid = canonical").select("uid").join(self.uniq, "uid")
        shown = strings.shown(F.col("seq"), F.col("seq2"))
        return chosen.withColumn("canonical", shown).join(self.sizes(), "canonical").select("canonical", "size", "seq", "seq2", *info)


def cluster(reads: DataFrame, distance: int | None = None, ratio: float = 5.0, algorithm: str = "mp", validate: bool = True, on_invalid: str = "fail", wildcard: str | None = "N", with_info: bool = False, fold_case: bool = True) -> Clustering:
    """Cluster reads (as ``sources.reads`` gives them).

    ``distance`` None takes it from the median length.  A negative one is taken as
    None.  ``ratio`` (1 or more) is for message passing only.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    if ratio < 1:
        raise ValueError("ratio must be 1 or more")
    if distance is not None and distance > strings.MAX_DISTANCE:
        raise ValueError(f"distance must be at most {strings.MAX_DISTANCE}")
    ship.ensure(reads.sparkSession)
    ship.true_sizes(reads.sparkSession)
    reads = sources.normalize(reads, validate, on_invalid, fold_case)
    try:
        uniq = materialize(collapse.ranked(collapse.collapse(reads, with_info=with_info)), "uniq")
    except Exception as e:
        if said := re.search(rf"{sources.INVALID}: \S*", str(e)):
            raise sources.InvalidInput(said[0]) from e
        raise
    shapes = uniq.groupBy("len", F.col("seq2").isNotNull().alias("mates")).agg(F.count("*").alias("n")).collect()
    if not shapes:
        raise sources.InvalidInput("input file empty")
    paired = any(r["mates"] for r in shapes)
    if distance is None or distance < 0:
        histogram = {}
        for r in shapes:
            histogram[r["len"]] = histogram.get(r["len"], 0) + r["n"]
        distance = strings.auto_distance(strings.median_length(sorted(histogram.items())))
    found = similarity.similar_pairs(uniq, distance, wildcard, paired, ratio if algorithm == "mp" else None)
    found = materialize(found, "pairs")
    if algorithm == "mp":
        assigned = message_passing.message_passing(uniq, found, ratio)
    elif algorithm == "spheres":
        assigned = spheres.spheres(uniq, found)
    else:
        assigned = materialize(spheres.components(uniq, found), "assigned")
    return Clustering(reads, uniq, found, assigned, distance)


def cluster_tags(reads: DataFrame, tag_length: int, tag_distance: int = 0, seq_distance: int | None = None, trim: int = 50, tag_algorithm: str = "mp", seq_algorithm: str = "mp", tag_ratio: float = 3, seq_ratio: float = 3, with_ids: bool = False, validate: bool = True) -> DataFrame:
    """Cluster tags and sequences apart, and return the reads that share both clusters (see ``umi.intersect``)."""
    ship.ensure(reads.sparkSession)
    ship.true_sizes(reads.sparkSession)
    parts = materialize(umi.split_tag(sources.normalize(reads, validate), tag_length, trim), "parts")
    sides = []
    for column, dist, ratio, algorithm in (("tag", tag_distance, tag_ratio, tag_algorithm), ("body", seq_distance, seq_ratio, seq_algorithm)):
        side = sources.from_dataframe(parts, column, id_col="read_id")
        found = cluster(side, dist, ratio, algorithm, validate=False)
        sides.append(found.tidy().select("read_id", "canonical"))
    return umi.intersect(parts, *sides, tag_length, with_ids)
