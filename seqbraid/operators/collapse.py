"""Equal sequences become one weighted record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqbraid.functions import strings
from seqbraid.plans.numbering import number_parts
from seqbraid.plans.shared import materialize

INFO = ("header", "qual", "header2", "qual2")


def collapse(reads: DataFrame, with_ids: bool = False, with_info: bool = False) -> DataFrame:
    """(seq, seq2, cnt, first_read_id[, read_ids][, header, qual, header2, qual2]) of each distinct record.

    Counts are summed; ``with_ids`` gathers the ids of a string in its row, sorted; headers and qualities are those of the record
    read first.  Counts and first ids combine before the shuffle.
    """
    columns = [F.sum("cnt").alias("cnt"), F.min("read_id").alias("first_read_id")]
    if with_ids:
        columns.append(F.sort_array(F.collect_list("read_id")).alias("read_ids"))
    if with_info:
        columns.append(F.min_by(F.struct(*INFO), "read_id").alias("_info"))
    found = reads.groupBy("seq", "seq2").agg(*columns)
    return found.select("*", "_info.*").drop("_info") if with_info else found


def ranked(uniq: DataFrame) -> DataFrame:
    """``uniq`` with key, len and uid, its place from 1 when sorted by length, then bytes.

    A range sort, whose partitions' sizes are then summed up; no window over all rows.
    """
    keyed = uniq.withColumn("key", strings.joined_mates(F.col("seq"), F.col("seq2"))).withColumn("len", F.length("key"))
    parts = keyed.orderBy("len", "key").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid"))
    return number_parts(materialize(parts, "sorted"), ["_part"], "_mid", "uid")
