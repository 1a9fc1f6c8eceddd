"""Array queries over cells (part, supplier) with a quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import ndarray as op

_C = "c AS (SELECT l_partkey AS x, l_suppkey AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).agg(F.max("l_quantity").alias("v"))


@register("array_slice", f"WITH {_C} SELECT x, y, v FROM c WHERE x BETWEEN 10 AND 60 AND y <= 5")
def _slice(spark, d):
    return op.slice_(cells(spark, d), {"x": (10, 60), "y": (None, 5)})


@register("array_project", f"WITH {_C} SELECT x, v FROM c")
def _project(spark, d):
    return op.project(cells(spark, d), ["x"], ["v"])


for _r, _f in {"sum": "sum(v)", "count": "count(v)", "min": "min(v)", "max": "max(v)", "mean": "round(avg(v), 9)"}.items():

    @register(f"array_agg_{_r}", f"WITH {_C} SELECT y, {_f} AS {_r} FROM c GROUP BY y")
    def _agg(spark, d, r=_r):
        out = op.aggregate(cells(spark, d), "v", r, "y")
        return out.withColumn(r, F.round(r, 9)) if r == "mean" else out


_AB = f"{_C}, a AS (SELECT * FROM c WHERE x % 2 = 0), b AS (SELECT x, y, v % 7 AS v FROM c WHERE x % 3 = 0)"
for _o, _s in {"add": "a.v + b.v", "sub": "a.v - b.v", "mul": "a.v * b.v", "div": "CASE WHEN b.v <> 0 THEN round(a.v / b.v, 9) END"}.items():

    @register(f"array_elementwise_{_o}", f"""WITH {_AB} SELECT x, y, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN {_s} ELSE coalesce(a.v, b.v) END AS v
      FROM a FULL JOIN b USING (x, y)""")
    def _elementwise(spark, d, o=_o):
        c = cells(spark, d)
        a, b = c.filter("x % 2 = 0"), c.filter("x % 3 = 0").withColumn("v", F.col("v") % 7)
        return op.elementwise(a, b, ["x", "y"], o, "v").withColumn("v", F.round("v", 9))


@register("array_rechunk", f"WITH {_C} SELECT x // 16 AS tile_x, y // 4 AS tile_y, count(*) AS n FROM c GROUP BY 1, 2")
def _rechunk(spark, d):
    return op.tile(cells(spark, d), {"x": 16, "y": 4}).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@register("array_z_order", "WITH " + _C + ", k AS (SELECT x, y, " + " + ".join(f"(((x >> {i}) & 1) << {2 * i}) + (((y >> {i}) & 1) << {2 * i + 1})" for i in range(12)) + " AS z FROM c) SELECT x, y, z FROM k")
def _z(spark, d):
    return cells(spark, d).select("x", "y", op.z_order(["x", "y"], 12).alias("z"))
