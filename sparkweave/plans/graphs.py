"""Graph queries on edges derived from supplier-part and customer-order relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import graph
from ..session import cut

#: Every line's order -> part -> supplier and order -> supplier; keys stay apart by n mod 3. No cycles, so recursive twins end by themselves.
_E = """i AS (SELECT l_orderkey * 3 AS o, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s FROM lineitem),
  e AS (SELECT o AS src, p AS dst FROM i UNION SELECT p, s FROM i UNION SELECT o, s FROM i)"""


def _between(lines, *pairs, once=True):
    """Edges (src, dst) of pairs of key columns, in one pass over the lines; distinct, or with repeats where not once."""
    ends = F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in pairs]))
    found = lines.select(ends.alias("e")).select("e.*")
    return found.distinct() if once else found


def edges(spark, d, once=True):
    o, p, s = F.col("l_orderkey") * 3, F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 3 + 2
    return _between(table(spark, d, "lineitem"), (o, p), (p, s), (o, s), once=once)


def sparse(spark, d):
    """All customers hung on every seventh: a graph of many small components."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("src"), (k - k % 7).alias("dst"))


_S = "e AS (SELECT c_custkey AS src, c_custkey - c_custkey % 7 AS dst FROM customer)"


@register("graph_neighbors", f"WITH {_E} SELECT dst FROM e WHERE src = 7 UNION SELECT src FROM e WHERE dst = 7")
def _neighbors(spark, d):
    return graph.both_ways(edges(spark, d)).filter("src = 7").select("dst")


@register("graph_traverse", f"""WITH RECURSIVE {_S}, t(node, hops) AS (SELECT 7::BIGINT, 0 UNION SELECT e.src, hops + 1 FROM t JOIN e ON e.dst = t.node WHERE hops < 4)
  SELECT node, min(hops) AS hops FROM t GROUP BY node""")
def _traverse(spark, d):
    back = sparse(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = spark.range(1).select(F.lit(7).cast("long").alias("node"))
    return graph.traverse(back, start, 4)


@register("graph_wcc", f"""WITH RECURSIVE {_S}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
  t(x, y) AS (SELECT x, x FROM b UNION SELECT t.x, b.y FROM t JOIN b ON b.x = t.y) SELECT x AS node, min(y) AS component FROM t GROUP BY x""")
def _wcc(spark, d):
    return graph.connected_components(sparse(spark, d))


_RANK = """n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n),
  g AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
  r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT n FROM c) FROM n UNION ALL
    (WITH prev AS (SELECT * FROM r), loose AS (SELECT coalesce(sum(rank), 0) AS m FROM prev WHERE node NOT IN (SELECT src FROM g)),
       got AS (SELECT e.dst AS node, sum(rank / deg) AS s FROM prev JOIN e ON e.src = prev.node JOIN g ON g.src = prev.node GROUP BY e.dst)
     SELECT i + 1, prev.node, 0.15 / (SELECT n FROM c) + 0.85 * (SELECT m FROM loose) / (SELECT n FROM c) + 0.85 * coalesce(s, 0)
     FROM prev LEFT JOIN got USING (node) WHERE i < 8))
  SELECT node, round(rank, 9) AS rank FROM r WHERE i = 8"""


@register("graph_pagerank", f"WITH RECURSIVE {_E}, {_RANK}")
def _pagerank(spark, d):
    return graph.pagerank(edges(spark, d, False), 8, tolerance=0.0, once=True).select("node", F.round("rank", 9).alias("rank"))


@register("graph_sssp", f"""WITH RECURSIVE {_E}, w AS (SELECT src, dst, ((src + dst) % 5 + 1.0)::DOUBLE AS weight FROM e),
  t(node, distance) AS (SELECT 3::BIGINT, 0.0::DOUBLE UNION SELECT w.dst, distance + weight FROM t JOIN w ON w.src = t.node)
  SELECT node, min(distance)::DOUBLE AS distance FROM t GROUP BY node""")
def _sssp(spark, d):
    w = edges(spark, d).withColumn("weight", (F.col("src") + F.col("dst")) % 5 + 1.0)
    return graph.shortest_distances(cut(w), 3)


_U = """u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
  t AS (SELECT a.src AS a, a.dst AS b, c.dst AS c FROM u a JOIN u c ON c.src = a.dst AND c.dst > a.dst JOIN u x ON x.src = a.src AND x.dst = c.dst WHERE a.src < a.dst)"""


def _number(found, lists):
    return found.agg(F.count("*").alias("n"))


@register("graph_triangles", f"WITH {_E}, {_U} SELECT count(*) AS n FROM t")
def _triangles(spark, d):
    return graph.triangles(edges(spark, d, False), _number)


_LCC = f"""{_U}, k AS (SELECT src AS node, count(*) AS k FROM u GROUP BY src),
  m AS (SELECT node, count(*) AS tr FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY node)
  SELECT node, coalesce(tr, 0) AS triangles, CASE WHEN k < 2 THEN 0 ELSE round(2.0 * coalesce(tr, 0) / (k * (k - 1)), 9) END AS coefficient FROM k LEFT JOIN m USING (node)"""


@register("graph_lcc", f"WITH {_E}, {_LCC}")
def _lcc(spark, d):
    return graph.clustering(edges(spark, d, False)).withColumn("coefficient", F.round("coefficient", 9))


@register("graph_degree", f"""WITH {_E}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), t AS (SELECT count(DISTINCT node) AS n FROM n)
  SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round((sum(o) + sum(i)) / (max(t.n) - 1), 9) AS centrality FROM n, t GROUP BY node""")
def _degree(spark, d):
    return graph.degrees(cut(edges(spark, d))).withColumn("centrality", F.round("centrality", 9))


#: Nation -> customer -> order -> part, all rows; keys stay apart by n mod 4.
_C = """e AS (SELECT c_nationkey::BIGINT * 4 AS src, c_custkey * 4 + 1 AS dst FROM customer UNION SELECT o_custkey * 4 + 1, o_orderkey * 4 + 2 FROM orders
  UNION SELECT l_orderkey * 4 + 2, l_partkey * 4 + 3 FROM lineitem)"""


@register("graph_match_chain", f"WITH {_C} SELECT a.src AS n0, b.src AS n1, c.src AS n2, c.dst AS n3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src")
def _match(spark, d):
    def key(name, at):
        return F.col(name).cast("long") * 4 + at

    e = table(spark, d, "customer").select(key("c_nationkey", 0).alias("src"), key("c_custkey", 1).alias("dst"))
    e = e.union(table(spark, d, "orders").select(key("o_custkey", 1), key("o_orderkey", 2)))
    e = e.union(table(spark, d, "lineitem").select(key("l_orderkey", 2), key("l_partkey", 3)).distinct())
    return graph.match_chain(cut(e), 3)


@register("graph_closeness_harmonic", f"""WITH RECURSIVE {_E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n),
  t(source, node, hops) AS (SELECT node, node, 0 FROM n UNION SELECT source, e.dst, hops + 1 FROM t JOIN e ON e.src = t.node),
  h AS (SELECT source, node, min(hops) AS hops FROM t GROUP BY ALL)
  SELECT source AS node, coalesce(round(sum((hops > 0)::INT) ** 2 / (max(c.n) - 1) / nullif(sum(hops), 0), 9), 0) AS closeness,
    round(sum(CASE WHEN hops > 0 THEN 1.0 / hops ELSE 0 END) / (max(c.n) - 1), 9) AS harmonic, max(hops) AS eccentricity FROM h, c GROUP BY source""")
def _closeness(spark, d):
    out = graph.centralities(edges(spark, d, False))
    return out.select("node", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 9).alias("harmonic"), "eccentricity")


@register("graph_k_core")
def _k_core(spark, d):
    return graph.k_core(edges(spark, d, False), 6)


@register("graph_label_propagation")
def _labels(spark, d):
    return graph.label_propagation(sparse(spark, d), 10)


#: The graph of the whole tables: customer -> part -> supplier -> customer for every line of every order; keys stay apart by n mod 3.
_A = """l AS (SELECT o_custkey * 3 AS c, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  e AS (SELECT c AS src, p AS dst FROM l UNION SELECT p, s FROM l UNION SELECT s, c FROM l)"""


def whole_edges(spark, d, once=True):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, p, s = F.col("o_custkey") * 3, F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 3 + 2
    return _between(lines, (c, p), (p, s), (s, c), once=once)


@register("graph_path_length", f"""WITH RECURSIVE {_A}, t(node, hops) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM t JOIN e ON e.src = t.node WHERE hops < 12)
  SELECT coalesce(min(hops) + 1, 0) AS n FROM t WHERE node = 12""")
def _path(spark, d):
    return graph.shortest_path(cut(whole_edges(spark, d)), 3, 12, 12).agg(F.count("*").alias("n"))


@register("graph_whole_degree", f"""WITH {_A}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), t AS (SELECT count(DISTINCT node) AS n FROM n)
  SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round((sum(o) + sum(i)) / (max(t.n) - 1), 9) AS centrality FROM n, t GROUP BY node""")
def _whole_degree(spark, d):
    return graph.degrees(cut(whole_edges(spark, d))).withColumn("centrality", F.round("centrality", 9))


@register("graph_whole_neighbors", f"WITH {_A} SELECT dst FROM e WHERE src = 15 UNION SELECT src FROM e WHERE dst = 15")
def _whole_neighbors(spark, d):
    return graph.both_ways(whole_edges(spark, d)).filter("src = 15").select("dst")


#: The twin of shortest distances stops at 60, more than the longest on sf0.01; those without a twin are tested against brute force.
for _name, _run, _sql in (
    ("traverse", lambda e: graph.traverse(e, e.sparkSession.range(1).select(F.lit(3).cast("long").alias("node")), 24),
     f"""WITH RECURSIVE {_A}, t(node, hops) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM t JOIN e ON e.src = t.node WHERE hops < 24)
  SELECT node, min(hops) AS hops FROM t GROUP BY node"""),
    ("sssp", lambda e: graph.shortest_distances(e.withColumn("weight", (F.col("src") + F.col("dst")) % 5 + 1.0), 3),
     f"""WITH RECURSIVE {_A}, w AS (SELECT src, dst, ((src + dst) % 5 + 1.0)::DOUBLE AS weight FROM e),
  t(node, distance) AS (SELECT 3::BIGINT, 0.0::DOUBLE UNION SELECT w.dst, distance + weight FROM t JOIN w ON w.src = t.node WHERE distance + weight <= 60)
  SELECT node, min(distance)::DOUBLE AS distance FROM t GROUP BY node"""),
):
    register(f"graph_whole_{_name}", _sql)(lambda spark, d, run=_run: run(cut(whole_edges(spark, d))))


@register("graph_whole_triangles", f"WITH {_A}, {_U} SELECT count(*) AS n FROM t")
def _whole_triangles(spark, d):
    return graph.triangles(cut(whole_edges(spark, d, False)), _number)


@register("graph_whole_lcc", f"WITH {_A}, {_LCC}")
def _whole_lcc(spark, d):
    return graph.clustering(cut(whole_edges(spark, d, False))).withColumn("coefficient", F.round("coefficient", 9))


@register("graph_whole_pagerank", f"WITH RECURSIVE {_A}, {_RANK}")
def _whole_pagerank(spark, d):
    return graph.pagerank(whole_edges(spark, d, False), 8, tolerance=0.0, once=True).select("node", F.round("rank", 9).alias("rank"))


@register("graph_whole_k_core")
def _whole_k_core(spark, d):
    return graph.k_core(whole_edges(spark, d, False), 6)


@register("graph_whole_label_propagation")
def _whole_labels(spark, d):
    return graph.label_propagation(whole_edges(spark, d, False), 10)


@register("graph_whole_wcc")
def _whole_wcc(spark, d):
    return graph.connected_components(whole_edges(spark, d, False))


@register("graph_subgraph", f"""WITH {_A}, n AS (SELECT 15 AS node UNION SELECT dst FROM e WHERE src = 15)
  SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def _subgraph(spark, d):
    return graph.subgraph(cut(whole_edges(spark, d)), spark.range(1).select(F.lit(15).cast("long").alias("node")), 1)


@register("graph_statistics", f"""WITH {_A}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), g AS (SELECT src, count(*) AS d FROM e GROUP BY src)
  SELECT (SELECT count(*) FROM n) AS nodes, sum(d)::BIGINT AS edges, 0::BIGINT AS loops, max(d) AS max_out, round(avg(d), 9) AS mean_out FROM g""")
def _statistics(spark, d):
    return graph.statistics(cut(whole_edges(spark, d))).withColumn("mean_out", F.round("mean_out", 9))


@register("graph_neighbors_as_of", """SELECT DISTINCT l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_custkey = 5 AND o_orderdate <= TIMESTAMP '1996-06-30'""")
def _neighbors_as_of(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = lines.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("o_orderdate").alias("valid_from"))
    return graph.neighbors_as_of(e, 5, F.lit("1996-06-30").cast("timestamp"))


@register("graph_optional_match", "SELECT c_custkey AS n0, o_orderkey AS n1 FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def _optional(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return graph.optional_chain(e, table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


#: Trade between nations, from every line of every order: the customer's nation -> the supplier's.
_N = """e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""


def trade(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return lines.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).distinct()


@register("graph_diameter", f"""WITH RECURSIVE {_N}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  t(source, node, hops) AS (SELECT node, node, 0 FROM n UNION SELECT source, e.dst, hops + 1 FROM t JOIN e ON e.src = t.node WHERE hops < 25),
  h AS (SELECT source, node, min(hops) AS hops FROM t GROUP BY ALL), x AS (SELECT source, max(hops) AS ecc FROM h GROUP BY source)
  SELECT max(ecc) AS diameter, min(ecc) AS radius FROM x WHERE ecc > 0""")
def _diameter(spark, d):
    return graph.extent(cut(trade(spark, d)))


@register("graph_betweenness")
def _betweenness(spark, d):
    e = cut(trade(spark, d))
    return graph.betweenness(e, graph.nodes(e)).withColumn("betweenness", F.round("betweenness", 9))
