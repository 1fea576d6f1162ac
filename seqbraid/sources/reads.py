"""Readers: raw text, FASTA, FASTQ, paired FASTQ, or any DataFrame.

All give (read_id, seq, cnt, header, qual, seq2, header2, qual2), read_id counting
records from 1 in file order.  Lines are numbered by file split: a count per split
is summed up, and each line adds its place within the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqbraid.functions import strings
from seqbraid.plans.numbering import number_parts

COLUMNS = ("read_id", "seq", "cnt", "header", "qual", "seq2", "header2", "qual2")
FORMATS = ("raw", "fasta", "fastq")


INVALID = "invalid input, offending sequence"


class InvalidInput(ValueError):
    """The input can't be read as asked."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, from 1; only a newline ends a line."""
    text = spark.read.option("lineSep", "\n").text(path)
    parts = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_mid"))
    return number_parts(parts, ["_file", "_start"], "_mid", "line_no")


def detect_format(spark: SparkSession, path: str) -> str:
    """By the first character: '>' is FASTA, '@' is FASTQ, anything else raw; an empty file is an error."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not first:
        raise InvalidInput("input file empty")
    return {">": "fasta", "@": "fastq"}.get(first[0]["value"][:1], "raw")


def _reads(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"read_id": "long", "cnt": "long"}
    return df.select(*(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A sequence a line, with an optional count after white space; without one the whole line is the sequence."""
    pattern = r"^\s*(\S+)\s+([+-]?\d+)"
    value = F.col("value")
    counted = value.rlike(pattern)
    seq = F.when(counted, F.regexp_extract(value, pattern, 1)).otherwise(value)
    count = F.when(counted, F.regexp_extract(value, pattern, 2).cast("long")).otherwise(1)
    return _reads(lines(spark, path), read_id=F.col("line_no"), seq=seq, cnt=count)


def _records(spark: SparkSession, path: str, size: int, fields: dict[str, int]) -> DataFrame:
    """Whole records of ``size`` lines; what is left of an unfinished one is dropped."""
    at = F.col("line_no") - 1
    parts = lines(spark, path).select(F.floor(at / size).cast("long").alias("rec"), (at % size).alias("part"), "value")
    values = [F.max(F.when(F.col("part") == i, F.col("value"))).alias(name) for name, i in fields.items()]
    return parts.groupBy("rec").agg(F.count("*").alias("n"), *values).where(F.col("n") == size).withColumn("read_id", F.col("rec") + 1)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Two lines a record, header and sequence."""
    found = _records(spark, path, 2, {"header": 0, "seq": 1})
    return _reads(found, read_id=F.col("read_id"), seq=F.col("seq"), cnt=F.lit(1), header=F.col("header"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four lines a record: header, sequence, plus, quality."""
    found = _records(spark, path, 4, {"header": 0, "seq": 1, "qual": 3})
    return _reads(found, read_id=F.col("read_id"), seq=F.col("seq"), cnt=F.lit(1), header=F.col("header"), qual=F.col("qual"))


def read_paired(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """Two FASTQ files, mates by position; the second may be longer but not shorter."""
    if {detect_format(spark, path1), detect_format(spark, path2)} != {"fastq"}:
        raise InvalidInput("paired input must be FASTQ")
    one, two = read_fastq(spark, path1), read_fastq(spark, path2)
    mate = two.select("read_id", *(F.col(c).alias(f"{c}2") for c in ("seq", "header", "qual")))
    both = one.drop("seq2", "header2", "qual2").join(mate, "read_id", "left")
    short = F.raise_error("the second file is shorter than the first").cast("string")
    return both.withColumn("seq2", F.when(F.col("seq2").isNull(), short).otherwise(F.col("seq2"))).select(*COLUMNS)


def read(spark: SparkSession, path: str, path2: str | None = None, fmt: str | None = None) -> DataFrame:
    """Reads of one file, or of a pair of FASTQ files, the format found out if not given."""
    if path2 is not None:
        return read_paired(spark, path, path2)
    fmt = fmt or detect_format(spark, path)
    if fmt not in FORMATS:
        raise InvalidInput(f"unknown format {fmt!r}")
    return {"raw": read_raw, "fasta": read_fasta, "fastq": read_fastq}[fmt](spark, path)


def from_dataframe(df: DataFrame, seq_col: str, count_col: str | None = None, id_col: str | None = None, mate_col: str | None = None) -> DataFrame:
    """Reads of a DataFrame; without ``id_col`` ids are unique but not consecutive.  Rows with a null string are left out."""
    key = F.col(id_col) if id_col else F.monotonically_increasing_id() + 1
    columns = {"read_id": key, "seq": F.col(seq_col), "cnt": F.col(count_col) if count_col else F.lit(1)}
    if mate_col:
        columns["seq2"] = F.col(mate_col)
    return _reads(df.where(F.col(seq_col).isNotNull()), **columns)


def normalize(reads: DataFrame, validate: bool = True, on_invalid: str = "fail", fold_case: bool = True) -> DataFrame:
    """Upper-case sequences, after a check of letters and length; ``on_invalid``: fail or drop."""
    if validate:
        good = strings.is_valid(F.col("seq")) & (F.col("seq2").isNull() | strings.is_valid(F.col("seq2")))
        if on_invalid == "drop":
            reads = reads.where(good)
        elif on_invalid == "fail":
            bad = F.raise_error(F.concat(F.lit(f"{INVALID}: "), F.col("seq"))).cast("string")
            reads = reads.withColumn("seq", F.when(good, F.col("seq")).otherwise(bad))
        else:
            raise InvalidInput(f"on_invalid must be fail or drop, not {on_invalid!r}")
    if fold_case:
        reads = reads.withColumns({"seq": strings.upper(F.col("seq")), "seq2": strings.upper(F.col("seq2"))})
    return reads
