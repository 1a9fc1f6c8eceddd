from pyspark.sql import functions as F

from sparkweave.functions import geo
from sparkweave.operators import spatial


def test_rows_at_one_place_and_clashing_columns_keep_all_pairs(spark):
    df = spark.createDataFrame([(1, "u", 10.0, 50.0), (2, "v", 10.0, 50.0), (2, "w", 10.1, 50.0), (3, "x", -170.0, -50.0)], "k int, t string, x double, y double")
    out = spatial.within_distance(df, df, 10_000.0)
    assert out.columns == ["a_k", "a_t", "a_x", "a_y", "b_k", "b_t", "b_x", "b_y", "metres"]
    assert sorted(r["a_t"] + r["b_t"] for r in out.collect()) == ["uu", "uv", "uw", "vu", "vv", "vw", "wu", "wv", "ww", "xx"]


def test_each_place_is_tested_once(spark, capsys):
    """The distance stands below the joins that give rows their pairs, not above them."""
    df = spark.createDataFrame([(1, 10.0, 50.0)], "k int, x double, y double")
    spatial.within_distance(df, df, 10_000.0).explain()
    plan = capsys.readouterr().out
    assert plan.count("ASIN") + plan.count("asin") and plan.count("Join") >= 3


def test_rings_that_meet_in_many_cells_give_one_pair(spark):
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 31.0, 0.0), (4, 70.0, 0.0)], "k int, x double, y double")
    rings = at.select("k", geo.rectangle(F.col("x"), F.col("y"), 15.5, 15.5).alias("ring"))
    got = sorted((r["a_k"], r["b_k"]) for r in spatial.intersecting(rings, rings, "k", "ring").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 4)]


def test_neighbours_around_the_globe_and_beyond_a_pole(spark):
    h = spark.createDataFrame([(179.999, 89.999)], "x double, y double").select(geo.geohash(F.col("x"), F.col("y"), 5).alias("h"))
    r = h.select(geo.geohash_neighbor(F.col("h"), 5, 1, 0).alias("e"), geo.geohash_neighbor(F.col("h"), 5, 0, 1).alias("n"),
                 geo.geohash(F.lit(-179.999), F.lit(89.999), 5).alias("want")).first()
    assert (r["e"], r["n"]) == (r["want"], None)
