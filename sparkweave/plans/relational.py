"""Scans, projections, predicates, joins, aggregates, windows, set operations, sorts, CTEs and DML as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import register, register_sql, table
from ..operators import recursive, relational

for name, text in {
    # --- scans and projections
    "scan_constant_row": "SELECT 1 + 2 AS three, 'a' AS letter",
    "scan_project_filter": """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net
        FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 24""",
    "scan_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "scan_point_get": "SELECT * FROM {orders} WHERE o_orderkey = 7",
    "scan_range": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 200",
    "scan_count": "SELECT count(*) AS n FROM {lineitem}",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')",
    "filter_not_in_list": "SELECT c_custkey FROM {customer} WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')",
    "filter_not_between": "SELECT p_partkey FROM {part} WHERE p_size NOT BETWEEN 5 AND 40",
    "filter_like": "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'z%'",
    "filter_ilike": "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%a%'",
    "filter_null_tests": "SELECT doc_id FROM {documents} WHERE text IS NOT NULL AND NOT (lang IS NULL)",
    "filter_boolean_tree": """SELECT l_orderkey, l_linenumber FROM {lineitem}
        WHERE (l_quantity > 45 OR l_discount < 0.01) AND NOT l_returnflag = 'N'""",
    "filter_column_compare": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_suppkey > l_partkey",
    "project_case_cast": """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid'
        ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code,
        CAST(o_orderkey AS STRING) AS key_text FROM {orders}""",
    "project_coalesce_nullif": """SELECT p_partkey, nullif(p_size, 10) AS size_or_null, coalesce(nullif(p_size, 10), -1) AS size_or
        FROM {part}""",
    # --- joins
    "join_inner": """SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "join_left": """SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey""",
    "join_right": """SELECT c.c_custkey, o.o_orderkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "join_full": """SELECT s.s_suppkey, c.c_custkey FROM {supplier} s FULL JOIN {customer} c
        ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0""",
    "join_semi": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_cross_small": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_using": """SELECT k, a.c_name, b.n FROM (SELECT c_custkey AS k, c_name FROM {customer}) a
        JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) b USING (k)""",
    "join_residual_outer": """SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o
        ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 20""",
    "join_multiway": """SELECT n.n_name, count(*) AS n_lines, round(sum(l.l_extendedprice), 2) AS total
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
    "join_self": """SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    # --- subqueries and CTEs
    "subquery_in": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)",
    "subquery_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})",
    "subquery_scalar": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})",
    "subquery_derived_table": """SELECT band, count(*) AS n FROM (SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS band
        FROM {orders}) x GROUP BY band""",
    "cte_chained": """WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 50000),
        per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT * FROM per WHERE n > 1""",
    "cte_recursive_values": """WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t""",
    "cte_recursive_tree": """WITH RECURSIVE e AS (SELECT r_name AS parent, n_name AS child FROM {nation} JOIN {region}
          ON n_regionkey = r_regionkey UNION ALL SELECT 'WORLD', r_name FROM {region}),
        t(node, depth) AS (SELECT 'WORLD', 0 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.node)
        SELECT node, depth FROM t""",
    # --- aggregates
    "agg_pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
        round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi
        FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "agg_global_empty": "SELECT count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS a FROM {lineitem} WHERE l_quantity < 0",
    "agg_count_distinct": """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(l_tax) AS taxed
        FROM {lineitem} GROUP BY l_returnflag""",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 8",
    "agg_group_expression": """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, upper(o_orderstatus) AS s, count(*) AS n
        FROM {orders} GROUP BY year(o_orderdate), upper(o_orderstatus)""",
    "agg_group_ordinal": "SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY 1, 2",
    "agg_group_all": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ALL",
    "agg_stddev_variance": """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss,
        round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM {lineitem} GROUP BY l_returnflag""",
    "agg_filtered": """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
        round(coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice > 1000), 0), 2) AS big FROM {orders} GROUP BY o_custkey""",
    "agg_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS r FROM {lineitem} GROUP BY l_returnflag",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_over_join": """SELECT c.c_mktsegment, count(o.o_orderkey) AS n, count(DISTINCT o.o_orderstatus) AS kinds
        FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment HAVING count(*) > 1""",
    # --- windows
    "window_ranking": """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr,
        round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""",
    "window_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM {orders}",
    "window_lag_lead": """SELECT conv_id, turn, lag(role) OVER w AS before, lead(role, 1, 'end') OVER w AS after
        FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""",
    "window_running": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, min(o_totalprice) OVER w AS lo,
        max(o_totalprice) OVER w AS hi FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "window_frame": """SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m FROM {orders}""",
    "window_first_last_nth": """SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l,
        nth_value(o_totalprice, 2) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    # --- sorts and limits
    "sort_multi_key": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_mktsegment DESC, c_acctbal NULLS LAST, c_custkey",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sort_after_aggregate": """SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM {orders} GROUP BY o_custkey
        ORDER BY t DESC, o_custkey LIMIT 10""",
    # --- set operations
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "set_union_sorted_limit": """SELECT c_nationkey AS k, 'c' AS side FROM {customer} UNION SELECT s_nationkey, 's' FROM {supplier}
        ORDER BY k, side LIMIT 7""",
}.items():
    register_sql(name, text)


@register("join_range", """SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s
        ON p.p_partkey % 10 = s.s_suppkey % 10 AND p.p_retailprice BETWEEN s.s_acctbal - 300 AND s.s_acctbal + 300""")
def _range(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("at"), (F.col("p_partkey") % 10).alias("k"))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 300).alias("low"), (F.col("s_acctbal") + 300).alias("high"), (F.col("s_suppkey") % 10).alias("k"))
    return relational.range_join(p, s, ["k"], "at", "low", "high", 150.0).select("p_partkey", "s_suppkey")


register_sql(
    "agg_string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
register_sql(
    "agg_array_agg",
    "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey",
)
register_sql(
    "agg_bool_any_every",
    "SELECT o_custkey, bool_or(o_totalprice > 150000) AS any_big, every(o_totalprice > 100) AS all_some FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, bool_or(o_totalprice > 150000) AS any_big, bool_and(o_totalprice > 100) AS all_some FROM orders GROUP BY o_custkey",
)


@register(
    "agg_percentile_cont",
    """SELECT l_returnflag, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS p90
        FROM lineitem GROUP BY l_returnflag""",
)
def _percentile(spark, d):
    out = relational.percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)
    return out.select("l_returnflag", F.round("percentile", 6).alias("p90"))


@register(
    "agg_nested_groups",
    """SELECT c_nationkey, sum(n)::BIGINT AS n, string_agg(c_mktsegment || ':' || n, ',' ORDER BY c_mktsegment) AS sub
       FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey""",
)
def _nested(spark, d):
    out = relational.nested_aggregate(table(spark, d, "customer"), ["c_nationkey"], ["c_mktsegment"], n=F.count("*"))
    item = lambda g: F.concat_ws(":", g["c_mktsegment"], g["n"].cast("string"))
    return out.select(
        "c_nationkey",
        F.aggregate("sub_groups", F.lit(0).cast("long"), lambda a, g: a + g["n"]).alias("n"),
        F.array_join(F.transform("sub_groups", item), ",").alias("sub"),
    )


@register(
    "agg_approx_within_bounds",
    "SELECT l_returnflag, true AS distinct_ok, true AS median_ok FROM lineitem GROUP BY l_returnflag",
)
def _approx(spark, d):
    """Sketches against exact values: within 5 % and 2 %. Each is an aggregate of its own, so that no sketch is kept per distinct value."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    g = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("p")
    )
    b = lines.groupBy(F.col("l_returnflag").alias("f")).agg(F.count_distinct("l_partkey").alias("b"))
    q = relational.percentile(lines.withColumnRenamed("l_returnflag", "r"), ["r"], "l_extendedprice", 0.5)
    g = g.join(b, F.col("l_returnflag").eqNullSafe(F.col("f"))).join(q, F.col("l_returnflag").eqNullSafe(F.col("r")))
    return g.select(
        "l_returnflag", (F.abs(F.col("a") / F.col("b") - 1) < 0.05).alias("distinct_ok"),
        (F.abs(F.col("p") / F.col("percentile") - 1) < 0.02).alias("median_ok"),
    )


@register(
    "agg_topk",
    """SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
       ORDER BY n DESC, event_type LIMIT 3""",
)
def _topk(spark, d):
    return relational.top_values(table(spark, d, "events"), "event_type", 3)


@register(
    "facet_counts",
    """SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM (
         SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1, 2 UNION ALL
         SELECT 'p_type', p_type, count(*) FROM part WHERE p_size > 10 GROUP BY 1, 2)) WHERE place <= 5""",
)
def _facets(spark, d):
    return relational.facets(table(spark, d, "part").filter("p_size > 10"), ["p_brand", "p_type"], 5)


@register(
    "merge_upsert",
    """SELECT coalesce(u.k, o.o_orderkey) AS o_orderkey,
              CASE WHEN u.k IS NULL THEN o.o_totalprice WHEN o.o_orderkey IS NULL THEN u.v ELSE o.o_totalprice + u.v END AS o_totalprice
       FROM orders o FULL JOIN (SELECT l_orderkey + 10 AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) u
         ON u.k = o.o_orderkey""",
)
def _upsert(spark, d):
    new = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy((F.col("l_orderkey") + 10).alias("o_orderkey"))
    new = new.agg(F.max("l_quantity").alias("o_totalprice"))
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return relational.upsert(old, new, ["o_orderkey"], {"o_totalprice": lambda o, n: o + n})


@register(
    "merge_insert_if_absent",
    """SELECT c_custkey AS k, 'old' AS side FROM customer UNION ALL
       SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _absent(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("side"))
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("side"))
    return relational.insert_if_absent(old, new, ["k"])


@register(
    "dml_update_delete",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3""",
)
def _dml(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    rows = relational.update(rows, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})
    return relational.delete(rows, F.col("s_nationkey") == 3).drop("s_nationkey")


@register(
    "recursive_distinct",
    """WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT (k * 3 + 1) % 25 FROM t) SELECT k::BIGINT AS k FROM t""",
)
def _recursive(spark, d):
    base = spark.range(1).select(F.col("id").alias("k"))
    return recursive.fixed_point(base, lambda new: new.select(((F.col("k") * 3 + 1) % 25).alias("k")))


@register(
    "tree_sum",
    """WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey),
       v AS (SELECT n_name AS node, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
             UNION ALL SELECT r_name, 0 FROM region),
       t(root, node) AS (SELECT node, node FROM v UNION ALL SELECT t.root, e.child FROM t JOIN e ON e.parent = t.node)
       SELECT root AS node, sum(n)::BIGINT AS total FROM t JOIN v USING (node) GROUP BY root""",
)
def _tree_sum(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("child"), F.col("r_name").alias("parent")
    )
    per = nation.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    values = per.groupBy(F.col("n_name").alias("node")).agg(F.count("c_custkey").alias("value"))
    values = values.unionByName(region.select(F.col("r_name").alias("node"), F.lit(0).cast("long").alias("value")))
    return recursive.tree_sum(edges, values)


@register("sort_nulls_default", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s ASC NULLS FIRST, p_partkey")
def _nulls(spark, d):
    return table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s")).orderBy("s", "p_partkey")


@register(
    "latest_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def _latest(spark, d):
    return relational.latest_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@register("weighted_pick_size", "SELECT 25::BIGINT AS n, true AS agree")
def _pick(spark, d):
    """Weighted sample without replacement: its size, and that a second draw with the seed agrees."""
    rows = table(spark, d, "customer").filter("c_acctbal > 0")
    a, b = (relational.weighted_pick(rows, "c_acctbal", 25, seed=7, key="c_custkey").select("c_custkey") for _ in range(2))
    return a.join(b.withColumn("hit", F.lit(1)), "c_custkey", "left").agg(
        F.count("*").alias("n"), (F.count("hit") == 25).alias("agree")
    )


@register(
    "validation_typeguard",
    """SELECT o_orderkey, o_totalprice >= 0 AS price_ok, o_orderstatus IN ('F', 'O') AS status_ok FROM orders
       WHERE NOT (o_totalprice >= 0 AND o_orderstatus IN ('F', 'O'))""",
)
def _guard(spark, d):
    checks = {"price_ok": F.col("o_totalprice") >= 0, "status_ok": F.col("o_orderstatus").isin("F", "O")}
    return relational.violations(table(spark, d, "orders"), checks).select("o_orderkey", *checks)


@register(
    "hash_chain_verify",
    """WITH c AS (SELECT event_id, sha256(event_id || event_type) AS h FROM events),
       p AS (SELECT event_id, h, lag(h, 1, '') OVER (ORDER BY event_id) AS prev FROM c)
       SELECT event_id, sha256(prev || h) AS link FROM p""",
)
def _chain(spark, d):
    rows = table(spark, d, "events").select("event_id", F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("h"))
    return relational.hash_links(rows, "event_id", "h").select("event_id", "link")


@register("agg_count_min", "SELECT DISTINCT user_id, true AS never_under, true AS close FROM events")
def _count_min(spark, d):
    e = table(spark, d, "events")
    true = e.groupBy("user_id").agg(F.count("*").alias("n"))
    est = relational.count_min_estimates(relational.count_min(e, "user_id"), true, "user_id").join(true, "user_id")
    # within e / width of the total, to a chance of e^-depth an item
    total = e.agg(F.count("*").alias("total"))
    return est.join(F.broadcast(total)).select("user_id", (F.col("estimate") >= F.col("n")).alias("never_under"),
                                               (F.col("estimate") <= F.col("n") + F.col("total") * 2.72 / 2048 + 1).alias("close"))
