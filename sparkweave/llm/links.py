"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import drop_written, written


def _hung(links: DataFrame) -> DataFrame:
    """(v, to): every node of a neighbourhood hung on the neighbourhood's least node."""
    least = links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return links.join(least, "u").select(F.col("u"), F.col("v"), F.col("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges must run from the greater to the lesser node."""
    hung = _hung(edges)
    ends = hung.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return ends.union(hung.select("u", F.col("low").alias("v")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    edges: (u long, v long), any direction, repeats allowed. Each round is written, so a lost executor
    costs one round; the count of rounds grows with the logarithm of the graph's size.
    """
    edges = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _state(edges)
    while before[0]:
        last, edges = edges, written(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        drop_written(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
