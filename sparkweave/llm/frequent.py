"""The most frequent keys of a count table, without a sort and without more than the asked number on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(n: Column) -> Column:
    """Exact up to 1024, then 64 levels a doubling: a few thousand levels in all."""
    return F.when(n <= 1024, n).otherwise(1024 + F.ceil(F.log2(n / 1024) * 64)).cast("long")


def most_frequent(counts: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Rows of counts (with a column n) of at least `least`, by whole levels of n from the top, at most `most` rows.

    The level that doesn't fit whole stays out, so the choice depends on the counts alone. counts is read twice.
    """
    level = _level(F.col("n"))
    held = counts.filter(F.col("n") >= least)
    rows = held.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    total, lowest = 0, None
    for r in rows:
        total += r["rows"]
        if total > most:
            break
        lowest = r["level"]
    return held.filter(level >= lowest if lowest is not None else F.lit(False))
