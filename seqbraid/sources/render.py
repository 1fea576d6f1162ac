"""Output layouts: one text line (or record) a row, with the columns they sort by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _ids(array: str):
    return F.array_join(F.col(array), ",")


def cluster_lines(clusters: DataFrame, members: bool = False, ids: bool = False, compat: bool = False) -> DataFrame:
    """``canonical TAB size`` with members and record ids if asked for.

    ``compat``: with ids but no members the canonical string is the third column, as
    one algorithm of the original tool prints it.
    """
    columns = ["canonical", F.col("size").cast("string")]
    if members:
        columns.append(F.array_join("members", ","))
    elif ids and compat:
        columns.append("canonical")
    if ids:
        columns.append(_ids("read_ids"))
    return clusters.orderBy(F.desc("size"), "canonical").select(F.concat_ws("\t", *columns).alias("value"))


def tidy_lines(tidy: DataFrame) -> DataFrame:
    """``sequence TAB canonical`` for each record, in input order."""
    return tidy.orderBy("read_id").select(F.concat_ws("\t", "seq", "canonical").alias("value"))


def unique_lines(unique: DataFrame, fmt: str, mate: int = 1) -> DataFrame:
    """The canonical records in the format they came in: raw, fasta or fastq; ``mate`` 2 takes the second file's."""
    seq, header, qual = ("seq", "header", "qual") if mate == 1 else ("seq2", "header2", "qual2")
    ordered = unique.orderBy(F.desc("size"), "canonical")
    if fmt == "raw":
        return ordered.select(F.col(seq).alias("value"))
    if fmt == "fasta":
        return ordered.select(F.concat_ws("\n", header, seq).alias("value"))
    if fmt == "fastq":
        return ordered.select(F.concat_ws("\n", header, seq, F.lit("+"), qual).alias("value"))
    raise ValueError(f"unknown format {fmt!r}")


def tag_lines(found: DataFrame, ids: bool = False) -> DataFrame:
    """``tag and sequence TAB reads`` with record ids if asked for."""
    columns = ["canonical", F.col("size").cast("string")] + [_ids("read_ids")] * ids
    return found.orderBy(F.desc("size"), "canonical").select(F.concat_ws("\t", *columns).alias("value"))


def write(lines: DataFrame, path: str) -> None:
    """Write lines in order; each part file holds a range of them."""
    lines.write.text(path)
