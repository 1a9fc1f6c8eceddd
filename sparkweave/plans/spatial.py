"""Spatial queries on points derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import geo
from ..operators import spatial as op

_P = """p AS (SELECT c_custkey AS k, (c_custkey * 7919 % 3600) / 10.0 - 180 AS x, (c_custkey * 104729 % 1600) / 10.0 - 80 AS y FROM customer),
  s AS (SELECT s_suppkey AS k, (s_suppkey * 7919 % 3600) / 10.0 - 180 AS x, (s_suppkey * 104729 % 1600) / 10.0 - 80 AS y FROM supplier)"""
_H = "2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians({b}y - {a}y) / 2) ** 2 + cos(radians({a}y)) * cos(radians({b}y)) * sin(radians({b}x - {a}x) / 2) ** 2)))"


def _points(spark, d, name, key):
    k = F.col(key)
    return table(spark, d, name).select(
        k.alias("k"), ((k * 7919) % 3600 / 10.0 - 180).alias("x"), ((k * 104729) % 1600 / 10.0 - 80).alias("y")
    )


@register("geo_distance_bearing", f"""WITH {_P} SELECT k, round({_H.format(a='', b='o.')}, 3) AS metres,
  round(fmod(degrees(atan2(sin(radians(o.x - p.x)) * cos(radians(o.y)), cos(radians(p.y)) * sin(radians(o.y)) - sin(radians(p.y)) * cos(radians(o.y))
    * cos(radians(o.x - p.x)))) + 360, 360), 6) AS bearing FROM p, (SELECT 10.0 AS x, 50.0 AS y) o""".replace("(y)", "(p.y)").replace("- y)", "- p.y)").replace("- x)", "- p.x)"))
def _distance(spark, d):
    p = _points(spark, d, "customer", "c_custkey")
    x, y = F.col("x"), F.col("y")
    return p.select("k", F.round(geo.haversine(x, y, F.lit(10.0), F.lit(50.0)), 3).alias("metres"),
                    F.round(geo.bearing(x, y, F.lit(10.0), F.lit(50.0)), 6).alias("bearing"))


@register("geo_join_dwithin", f"""WITH {_P} SELECT p.k AS a, s.k AS b FROM p JOIN s ON {_H.format(a='p.', b='s.')} <= 1500000""")
def _dwithin(spark, d):
    out = op.within_distance(_points(spark, d, "customer", "c_custkey"), _points(spark, d, "supplier", "s_suppkey"), 1500000.0)
    return out.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))


@register("geo_nearest", f"""WITH {_P} SELECT k FROM (SELECT k, {_H.format(a='q.', b='p.')} AS m FROM p, (SELECT 2.0 AS x, 48.0 AS y) q) ORDER BY m, k LIMIT 10""")
def _nearest(spark, d):
    return op.nearest(_points(spark, d, "customer", "c_custkey"), 2.0, 48.0, 10, "k").select("k")


@register("geo_contains_polygon", f"""WITH {_P} SELECT k FROM p WHERE (y > 0 AND y < 40 AND x > y / 2.0 - 20 AND x < 60 - y / 4.0)""")
def _contains(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-20.0, 0.0), (60.0, 0.0), (50.0, 40.0), (0.0, 40.0), (-20.0, 0.0))])
    return _points(spark, d, "customer", "c_custkey").filter((F.col("y") != 0) & geo.contains(ring, F.col("x"), F.col("y"))).select("k")


_BITS = " || ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + "
    + " + ".join(f"{16 >> j} * (({'cx' if (5 * i + j) % 2 == 0 else 'cy'} >> {(13 if (5 * i + j) % 2 == 0 else 12) - 1 - (5 * i + j) // 2}) & 1)" for j in range(5))
    + ", 1)"
    for i in range(5)
)


@register("geo_geohash", f"""WITH {_P}, c AS (SELECT k, least(floor((x + 180) / 360 * 8192), 8191)::BIGINT AS cx, least(floor((y + 90) / 180 * 4096), 4095)::BIGINT AS cy FROM p)
  SELECT k, {_BITS} AS hash FROM c""")
def _geohash(spark, d):
    return _points(spark, d, "customer", "c_custkey").select("k", geo.geohash(F.col("x"), F.col("y"), 5).alias("hash"))


@register("geo_line_length_envelope", f"""WITH {_P}, l AS (SELECT k // 10 AS g, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY k // 10 ORDER BY k))
  SELECT g, round(coalesce(sum({_H.format(a='p', b='')}) FILTER (WHERE px IS NOT NULL), 0), 2) AS metres, min(x) AS min_x, max(y) AS max_y, count(*) AS n FROM l GROUP BY g""")
def _lines(spark, d):
    p = _points(spark, d, "customer", "c_custkey").withColumn("g", F.floor(F.col("k") / 10))
    l = p.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("line"))
    e = geo.envelope(F.col("line"))
    return l.select("g", F.round(geo.length(F.col("line")), 2).alias("metres"), e["min_x"].alias("min_x"), e["max_y"].alias("max_y"),
                    F.size("line").cast("long").alias("n"))


@register("geo_geohash_decode", f"""WITH {_P}, c AS (SELECT k, least(floor((x + 180) / 360 * 8192), 8191)::BIGINT AS cx, least(floor((y + 90) / 180 * 4096), 4095)::BIGINT AS cy FROM p)
  SELECT k, round((cx + 0.5) / 8192 * 360 - 180, 9) AS x, round((cy + 0.5) / 4096 * 180 - 90, 9) AS y FROM c""")
def _geohash_decode(spark, d):
    h = _points(spark, d, "customer", "c_custkey").select("k", geo.geohash(F.col("x"), F.col("y"), 5).alias("h"))
    at = geo.geohash_decode(F.col("h"), 5)
    return h.select("k", F.round(at["x"], 9).alias("x"), F.round(at["y"], 9).alias("y"))


@register("geo_geohash_neighbors", f"""WITH {_P}, g AS (SELECT k, least(floor((x + 180) / 360 * 8192), 8191)::BIGINT AS gx, least(floor((y + 90) / 180 * 4096), 4095)::BIGINT AS gy FROM p),
  c AS (SELECT k, e, n, (gx + e + 8192) % 8192 AS cx, gy + n AS cy FROM g, (SELECT unnest([-1, 0, 1]) AS e), (SELECT unnest([-1, 0, 1]) AS n) WHERE e <> 0 OR n <> 0)
  SELECT k, e AS east, n AS north, {_BITS} AS hash FROM c""")
def _geohash_neighbors(spark, d):
    h = _points(spark, d, "customer", "c_custkey").select("k", geo.geohash(F.col("x"), F.col("y"), 5).alias("h"))
    steps = F.array(*[F.struct(F.lit(e).alias("east"), F.lit(n).alias("north")) for e in (-1, 0, 1) for n in (-1, 0, 1) if e or n])
    x, y = geo.geohash_cells(F.col("h"), 5)
    # decoded once a point, before the steps; spread, since few files of keys make many rows of work
    cells = h.repartition("k").select("k", x.alias("x"), y.alias("y"), F.explode(steps).alias("s")).select("k", "x", "y", "s.*")
    return cells.select("k", "east", "north", geo.neighbor_cells(F.col("x"), F.col("y"), 5, F.col("east"), F.col("north")).alias("hash"))


@register("geo_text_formats", f"WITH {_P} SELECT k, x AS wkt_x, y AS wkt_y, x AS json_x, y AS json_y, true AS other_is_null FROM p")
def _formats(spark, d):
    x, y = F.col("x"), F.col("y")
    w, j = geo.point_from_wkt(geo.point_wkt(x, y)), geo.point_from_geojson(geo.point_geojson(x, y))
    return _points(spark, d, "customer", "c_custkey").select(
        "k", w["x"].alias("wkt_x"), w["y"].alias("wkt_y"), j["x"].alias("json_x"), j["y"].alias("json_y"),
        geo.point_from_wkt(F.concat(F.lit("LINE"), geo.point_wkt(x, y))).isNull().alias("other_is_null"),
    )


@register("geo_polygon_measures", f"""WITH {_P} SELECT k, round(2 * 6371000.0 * radians(4.0) + 2 * 6371000.0 * asin(cos(radians(y - 2)) * sin(radians(3.03)))
    + 2 * 6371000.0 * asin(cos(radians(y + 2)) * sin(radians(3.03))), 2) AS perimeter, 5 AS points, round(x - 3.03, 6) AS min_x, round(y + 2, 6) AS max_y,
  x - 3.03 >= -180 AND x + 3.03 <= 180 AS valid FROM p""")
def _measures(spark, d):
    ring = F.col("ring")
    p = _points(spark, d, "customer", "c_custkey").withColumn("ring", geo.rectangle(F.col("x"), F.col("y"), 3.03, 2.0))
    e = geo.envelope(ring)
    return p.select("k", F.round(geo.length(ring), 2).alias("perimeter"), F.size(ring).alias("points"), F.round(e["min_x"], 6).alias("min_x"),
                    F.round(e["max_y"], 6).alias("max_y"), geo.is_valid_ring(ring).alias("valid"))


@register("geo_intersects", f"WITH {_P} SELECT p.k AS a, s.k AS b FROM p JOIN s ON abs(p.x - s.x) <= 5.03 AND abs(p.y - s.y) <= 4.03")
def _intersects(spark, d):
    boxes = lambda name, key, w, h: _points(spark, d, name, key).select("k", geo.rectangle(F.col("x"), F.col("y"), w, h).alias("ring"))
    out = op.intersecting(boxes("customer", "c_custkey", 3.03, 2.03), boxes("supplier", "s_suppkey", 2.0, 2.0), "k", "ring")
    return out.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))
