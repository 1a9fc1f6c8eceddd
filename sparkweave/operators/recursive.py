"""Fixed points: recursion with distinct union, and sums over trees."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Rounds after which what has been seen is written as one table, so that a round reads few of them.
MERGE = 8


def fixed_point(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """UNION DISTINCT recursion: step is applied to the rows that the round before added, until none are new.

    With limit, more rounds than that are an error, never a shorter result.
    """
    total = new = cut(base.distinct())
    for i in count(1):
        new = cut(step(new).distinct().join(total, base.columns, "left_anti"))
        if new.isEmpty():
            return total
        if limit is not None and i >= limit:
            raise RuntimeError(f"rows are still added after {limit} rounds")
        total = total.unionByName(new)
        total = total if i % MERGE else cut(total)


def tree_sum(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, total): value of each node with all its descendants. edges (parent, child), values (node, value)."""
    at = values.select(F.col("node").alias("root"), "node")
    hop = edges.select(F.col("parent").alias("node"), "child")
    pairs = fixed_point(at, lambda new: new.join(hop, "node").select("root", F.col("child").alias("node")))
    return pairs.join(values, "node").groupBy(F.col("root").alias("node")).agg(F.sum("value").alias("total"))
