"""Consecutive row numbers without gathering the rows in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqbraid.plans.shared import materialize


def number_parts(parts: DataFrame, part: list[str], mid: str, name: str) -> DataFrame:
    """Number rows from 1, part after part and by ``mid`` within a part.

    ``mid`` rises by 1 from row to row of a part, as ``monotonically_increasing_id``
    does.  Only a row per part (file split, sort partition) meets in one window; that
    table is written, so that its size decides whether it is broadcast.
    """
    size = parts.groupBy(*part).agg(F.count("*").alias("_rows"), F.min(mid).alias("_first"))
    before = F.sum("_rows").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1))
    base = size.select(*part, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_base"))
    numbered = parts.join(materialize(base, "bases"), part)
    return numbered.withColumn(name, F.col("_base") + F.col(mid)).drop("_base", mid, *part)
