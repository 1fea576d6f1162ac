"""Two-key clusters: a tag at the start of each read, and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqbraid.plans.shared import materialize


def split_tag(reads: DataFrame, tag_length: int, trim: int = 50) -> DataFrame:
    """(read_id, tag, body, tail, break_at) of reads; a pair gives both mates' tags and bodies joined.

    ``trim``: letters of the body that are clustered, the tail being what follows;
    0 takes all.  ``break_at``: where the second mate begins in the body.
    """
    paired = F.col("seq2").isNotNull()
    mate = F.coalesce("seq2", F.lit(""))
    tag = F.concat(F.substring("seq", 1, tag_length), F.substring(mate, 1, tag_length))
    rest = F.concat(F.expr(f"substring(seq, {tag_length + 1})"), F.expr(f"substring(coalesce(seq2, ''), {tag_length + 1})"))
    parts = reads.select("read_id", tag.alias("tag"), rest.alias("rest"), F.when(paired, F.greatest(F.length("seq") - tag_length, F.lit(0))).alias("break_at"))
    body = F.substring("rest", 1, trim) if trim else F.col("rest")
    tail = F.expr(f"substring(rest, {trim + 1})") if trim else F.lit("")
    return parts.select("read_id", "tag", body.alias("body"), tail.alias("tail"), "break_at")


def common_tail(members: DataFrame) -> DataFrame:
    """(seq_canonical, tail): the most frequent tail of each cluster.

    Of equally frequent ones, that which reached the number at the smallest read id.
    """
    # A tail with n reads reaches n at its last one.
    reached = members.groupBy("seq_canonical", "tail").agg(F.count("*").alias("n"), F.max("read_id").alias("at"))
    return reached.groupBy("seq_canonical").agg(F.min_by("tail", F.struct(-F.col("n"), "at")).alias("tail"))


def intersect(parts: DataFrame, tags: DataFrame, bodies: DataFrame, tag_length: int, with_ids: bool = False) -> DataFrame:
    """(tag_canonical, seq_canonical, canonical, size[, read_ids]): reads that share both clusters.

    ``tags`` and ``bodies``: (read_id, canonical) of the two clusterings.
    ``with_ids`` gathers the ids of a group in its row.
    """
    joined = parts.join(tags.select("read_id", F.col("canonical").alias("tag_canonical")), "read_id").join(bodies.select("read_id", F.col("canonical").alias("seq_canonical")), "read_id")
    members = materialize(joined, "members")
    tails = common_tail(members)
    breaks = members.groupBy("seq_canonical").agg(F.min_by(F.struct("break_at"), "read_id").alias("first"))
    ids = [F.sort_array(F.collect_list("read_id")).alias("read_ids")] * with_ids
    grouped = members.groupBy("seq_canonical", "tag_canonical").agg(F.count("*").alias("size"), *ids)
    full = grouped.join(tails, "seq_canonical").join(breaks, "seq_canonical").withColumn("seq", F.concat("seq_canonical", "tail")).withColumn("at", F.col("first.break_at"))
    single = F.concat("tag_canonical", "seq")
    both = F.concat(F.substring("tag_canonical", 1, tag_length), F.expr("substring(seq, 1, at)"), F.lit("/"), F.expr(f"substring(tag_canonical, {tag_length + 1})"), F.expr("substring(seq, at + 1)"))
    return full.select("tag_canonical", F.col("seq").alias("seq_canonical"), F.when(F.col("at").isNull(), single).otherwise(both).alias("canonical"), "size", *["read_ids"] * with_ids)
