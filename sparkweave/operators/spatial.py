"""Spatial joins by grid cells, so that a pair is only tested where its cells touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Metres in a degree of latitude.
DEGREE = 111_194.9


def _around(band: Column, high: float) -> Column:
    """Cells around the globe in a band of latitude: each as wide as the distance reaches there, one where it reaches a pole."""
    edge = F.greatest(F.abs(band * high), F.abs((band + 1) * high))
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(high, 90.0)))) / F.cos(F.radians(edge))))) * 1.001
    return F.when(edge + high >= 90, F.lit(1)).otherwise(F.greatest(F.floor(360 / reach), F.lit(1)).cast("int"))


def within_distance(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs of rows (columns x, y in degrees on both sides, renamed a_*, b_*) at most metres apart, with their metres.

    Distances are taken between different places only; rows at the same place get their pairs by joins on the place.
    """
    a = a.select([F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    near = _near(a.select("a_x", "a_y").distinct(), b.select("b_x", "b_y").distinct(), metres)
    return a.join(near.join(b, ["b_x", "b_y"]), ["a_x", "a_y"]).select(*a.columns, *b.columns, "metres")


def _near(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs of places at most metres apart.

    Latitude is cut in bands at least metres high, a band in cells at least as wide as metres reach there; b is sent to its
    own and the neighbouring cells of its own and the neighbouring bands, each once.
    """
    high = metres / DEGREE * 1.001
    cell = lambda x, n: F.pmod(F.floor((x + 180) / 360 * n), n)
    a = a.withColumn("_j", F.floor(F.col("a_y") / high)).withColumn("_i", cell(F.col("a_x"), _around(F.col("_j"), high)))
    b = b.withColumn("_j", F.explode(F.array(*[F.floor(F.col("b_y") / high) + j for j in (-1, 0, 1)])))
    n = _around(F.col("_j"), high)
    beside = F.array_distinct(F.array(*[F.pmod(cell(F.col("b_x"), n) + i, n) for i in (-1, 0, 1)]))
    b = b.withColumn("_i", F.explode(beside))
    met = a.join(b, ["_i", "_j"]).withColumn("metres", geo.haversine(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")))
    return met.filter(F.col("metres") <= metres).drop("_i", "_j")


def nearest(df: DataFrame, lon: float, lat: float, k: int, key: str) -> DataFrame:
    d = geo.haversine(F.lit(lon), F.lit(lat), F.col("x"), F.col("y"))
    return df.withColumn("metres", d).orderBy("metres", key).limit(k)


def intersecting(a: DataFrame, b: DataFrame, key: str, ring: str, cell: float = 10.0) -> DataFrame:
    """(a_<key>, b_<key>): pairs of rings that share a point.

    Different rings meet in the grid cells of their envelopes and are tested in one of them, where the envelopes overlap; rows
    with the same ring get their pairs by joins on the ring.
    """
    def rows(df, side):
        return df.select(F.col(key).alias(f"{side}_{key}"), F.col(ring).alias(f"{side}_ring"))

    def dealt(df, side):
        df = df.select(f"{side}_ring").distinct().withColumn(side, geo.envelope(F.col(f"{side}_ring")))
        span = lambda at: F.sequence(F.floor(F.col(f"{side}.min_{at}") / cell), F.floor(F.col(f"{side}.max_{at}") / cell))
        return df.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))

    low = lambda at: F.greatest(f"a.min_{at}", f"b.min_{at}")
    over = lambda at: low(at) <= F.least(f"a.max_{at}", f"b.max_{at}")
    first = (F.col("cx") == F.floor(low("x") / cell)) & (F.col("cy") == F.floor(low("y") / cell))
    x, y = rows(a, "a"), rows(b, "b")
    met = dealt(x, "a").join(dealt(y, "b"), ["cx", "cy"]).filter(over("x") & over("y") & first)
    met = met.filter(geo.intersects(F.col("a_ring"), F.col("b_ring"))).select("a_ring", "b_ring")
    return x.join(met.join(y, "b_ring"), "a_ring").select(f"a_{key}", f"b_{key}").distinct()
