"""String functions of the clustering engine, all on the JVM side."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, functions as F

MAX_DISTANCE = 8
MAX_LENGTH = 1023
#: Between the mates of a pair: one dash more than the largest distance.
PAIR_SEPARATOR = "-" * (MAX_DISTANCE + 1)
ALPHABET = "ACGTN"


def upper(seq: Column) -> Column:
    """ASCII upper case."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def is_valid(seq: Column, alphabet: str = ALPHABET, max_length: int = MAX_LENGTH) -> Column:
    """Letters of the alphabet only, in either case, and not too long; an empty string is valid."""
    return F.coalesce(seq.rlike(f"^[{alphabet}{alphabet.lower()}]*$") & ~seq.contains("\n") & (F.length(seq) <= max_length), F.lit(False))


def distance(a: Column, b: Column, most: int, wildcard: str | None = "N") -> Column:
    """Edit distance up to ``most``, else -1; ``wildcard`` matches nothing, itself included."""
    if wildcard:
        a = F.translate(a, wildcard, "#")
    return F.levenshtein(a, b, most)


def pair_distance(a1: Column, a2: Column, b1: Column, b2: Column, most: int, wildcard: str | None = "N") -> Column:
    """Sum of the mates' distances up to ``most``, else -1."""
    one, two = distance(a1, b1, most, wildcard), distance(a2, b2, most, wildcard)
    return F.when((one >= 0) & (two >= 0) & (one + two <= most), one + two).otherwise(-1)


def joined_mates(seq: Column, mate: Column) -> Column:
    """The order key of a record: the sequence, or both mates around the separator."""
    return F.when(mate.isNull(), seq).otherwise(F.concat(seq, F.lit(PAIR_SEPARATOR), mate))


def shown(seq: Column, mate: Column) -> Column:
    """A record as it is printed: the sequence, or mates with a slash between."""
    return F.when(mate.isNull(), seq).otherwise(F.concat(seq, F.lit("/"), mate))


def length_histogram(uniq: DataFrame) -> list[tuple[int, int]]:
    """(length, how many unique strings), by length."""
    return sorted((r["len"], r["n"]) for r in uniq.groupBy("len").agg(F.count("*").alias("n")).collect())


def median_length(histogram: list[tuple[int, int]]) -> int:
    """The least length that half of the unique strings don't exceed; 1 for a single string."""
    half, seen = sum(n for _, n in histogram) // 2, 0
    for length, n in histogram if half else []:
        seen += n if length else 0
        if length and seen >= half:
            return length
    return 1


def auto_distance(median: int) -> int:
    """8 for medians over 160, else 2 and one more for each 30 letters."""
    return MAX_DISTANCE if median > 160 else 2 + median // 30


def output_name(path: str, mark: str = "-clustered") -> str:
    """``mark`` before the last dot of the file's name, or at its end."""
    name = PurePosixPath(path)
    stem, dot, suffix = name.name.rpartition(".")
    return str(name.with_name(f"{stem}{mark}.{suffix}" if dot and stem else f"{name.name}{mark}"))
