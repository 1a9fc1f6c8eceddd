from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import graph, promql, recursive, spatial
from sparkweave.session import cut


def metres(a, b):
    (x1, y1), (x2, y2) = [(radians(x), radians(y)) for x, y in (a, b)]
    h = sin((y2 - y1) / 2) ** 2 + cos(y1) * cos(y2) * sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * asin(min(1, sqrt(h)))


@pytest.mark.parametrize("limit", [30_000.0, 300_000.0, 4_000_000.0])
def test_pairs_near_poles_and_date_line(spark, limit):
    points = [(x, y) for x in range(-180, 180, 37) for y in (-90, -89.9, -88, -60, 0, 0.1, 45, 79, 88, 89, 90)] + [(179.95, 10), (-179.95, 10), (179.95, 88)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = sorted((r["a_k"], r["b_k"]) for r in spatial.within_distance(df, df, limit).collect())
    want = sorted((i, j) for i, a in enumerate(points) for j, b in enumerate(points) if metres(a, b) <= limit)
    assert got == want


def test_deep_graphs_are_walked_to_the_end(spark):
    chain = spark.range(80).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.centralities(chain, start).first()["eccentricity"] == 80
    assert graph.extent(chain, start).first()["diameter"] == 80
    assert sorted(tuple(r) for r in graph.subgraph(chain, start, 2).collect()) == [(0, 1), (1, 2)]


def test_recursion_limit_is_an_error(spark):
    one = spark.createDataFrame([(0,)], "n int")
    grow = lambda df: df.filter("n < 20").select((F.col("n") + 1).alias("n"))
    assert recursive.fixed_point(one, grow).count() == 21
    with pytest.raises(RuntimeError):
        recursive.fixed_point(one, grow, limit=5)


def test_smoothing(spark):
    rows = [(s, f"2024-01-01 00:00:0{i}", float(v)) for s, values in (("a", (3, 5, 4, 8)), ("b", (7,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["s"]: r["value"] for r in promql.holt_winters(df, ["s"], 0.3, 0.1, 1704067210, 1704067210, 60, 60).collect()}
    level, slope = 3.0, 2.0
    for v in (5, 4, 8):
        last, level = level, 0.3 * v + 0.7 * (level + slope)
        slope = 0.1 * (level - last) + 0.9 * slope
    assert got["b"] == 7 and abs(got["a"] - level) < 1e-12


def test_wedges_that_cannot_close_are_not_sent(spark, capsys):
    """Stars without a triangle around one: of a node's list only what its neighbour's list reaches leaves the node."""
    hub = [(f, 1000 + h) for f in range(40) for h in range(5)] + [(1000, 2000), (0, 2000)]
    e = spark.createDataFrame(hub, "src long, dst long")
    assert [sorted(r) for r in graph.triangles(e).collect()] == [[0, 1000, 2000]]


def test_cuts_are_columnar_tables(spark):
    files = cut(spark.range(10)).inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)


def test_centralities_in_blocks_and_cycles(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(0, 3), (6, 0), (5, 5)], "src long, dst long")
    whole = sorted(tuple(r) for r in graph.centralities(ring, graph.nodes(ring)).collect())
    monkeypatch.setattr(graph, "PAIRS", 10)
    assert sorted(tuple(r) for r in graph.centralities(ring, graph.nodes(ring)).collect()) == whole
    assert whole[6] == (6, pytest.approx(6 / (1 + 2 + 3 + 2 + 3 + 4)), pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 2 + 1 / 3 + 1 / 4) / 6), 4)


def test_long_lists_of_neighbours_are_split(spark):
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    got = graph.centralities(star, spark.range(1).withColumnRenamed("id", "node")).first()
    assert (got["closeness"], got["eccentricity"]) == (1.0, 1)
