"""Betweenness against brute force; rings, texts and geohashes at their edges."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import geo
from sparkweave.operators import graph, relational, spatial


def brandes(edges):
    out, score = {}, {n: 0.0 for e in edges for n in e}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    for s in score:
        order, paths, far, before, queue = [], {s: 1.0}, {s: 0}, {}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out.get(v, ()):
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before.setdefault(w, []).append(v)
        share = {v: 0.0 for v in order}
        for w in reversed(order):
            for v in before.get(w, ()):
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score


@pytest.mark.parametrize("pairs", [
    [(i, i * 7 % 23) for i in range(23)] + [(i, (i + 3) % 23) for i in range(20)],
    [(i, i + 1) for i in range(6)],
    [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 5), (1, 2)],
])
def test_betweenness(spark, pairs):
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.betweenness for r in graph.betweenness(e, graph.nodes(e)).collect()}
    want = brandes(set(pairs))
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_betweenness_of_nothing(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.betweenness(e, graph.nodes(e)).count() == 0
    row = graph.statistics(e).first()
    assert (row.nodes, row.edges, row.max_out) == (0, 0, None)


def test_rings(spark):
    box = lambda x, y, w: [(x + i * w, y + j * w) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    rows = [(1, box(0.0, 0.0, 10.0)), (2, box(0.0, 0.0, 1.0)), (3, box(20.0, 0.0, 10.0)), (4, box(60.0, 0.0, 5.0)), (5, [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, "k int, ring array<struct<x: double, y: double>>")
    full = df.filter("k < 5")
    got = {(r.a_k, r.b_k) for r in spatial.intersecting(full, full, "k", "ring", 4.0).collect()}
    # 2 lies within 1 and meets no edge of it; 1 and 3 share an edge
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 1), (1, 3), (3, 1)}
    valid = {r.k: r.v for r in df.select("k", geo.is_valid_ring(F.col("ring")).alias("v")).collect()}
    assert valid == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_texts_and_geohashes(spark):
    rows = [("POINT(1.5 -2e1)",), ("POINT (1 )",), (None,), ("POLYGON((0 0))",)]
    df = spark.createDataFrame(rows, "w string")
    assert [r.p and tuple(r.p) for r in df.select(geo.point_from_wkt(F.col("w")).alias("p")).collect()] == [(1.5, -20.0), None, None, None]
    j = spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}',), ('{"type":"LineString","coordinates":[]}',), ("?",), (None,)], "j string")
    assert [r.p and tuple(r.p) for r in j.select(geo.point_from_geojson(F.col("j")).alias("p")).collect()] == [(1.0, 2.0), None, None, None]
    at = spark.createDataFrame([(179.99, 89.9)], "x double, y double").select(geo.geohash(F.col("x"), F.col("y"), 4).alias("h"))
    east, north = at.select(geo.geohash_neighbor(F.col("h"), 4, 1, 0), geo.geohash_neighbor(F.col("h"), 4, 0, 1)).first()
    first = spark.createDataFrame([(-179.99, 89.9)], "x double, y double").select(geo.geohash(F.col("x"), F.col("y"), 4)).first()[0]
    assert east == first and north is None


def test_count_min_never_under(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("v"))
    true = df.groupBy("v").agg(F.count("*").alias("n"))
    est = relational.count_min_estimates(relational.count_min(df, "v", 3, 64), true, "v", 3, 64).join(true, "v")
    assert est.count() == 700 and est.filter("estimate < n").isEmpty()
