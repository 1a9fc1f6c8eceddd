"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, register_sql, table
from ..functions import json as js
from ..functions import scalar as fn

register_sql(
    "fn_string",
    """SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, octet_length(c_name) AS bytes, substring(c_name, 2, 5) AS part,
       replace(c_name, '0', 'x') AS rep, reverse(c_name) AS rev, trim(concat('  ', c_name, ' ')) AS trimmed,
       concat_ws('', c_name, '-', c_mktsegment) AS joined FROM {customer}""",
    """SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, strlen(c_name)::INT AS bytes, substring(c_name, 2, 5) AS part,
       replace(c_name, '0', 'x') AS rep, reverse(c_name) AS rev, trim(concat('  ', c_name, ' ')) AS trimmed,
       concat(c_name, '-', c_mktsegment) AS joined FROM customer""",
)
register_sql(
    "fn_math",
    """SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f,
       round(sqrt(p_retailprice), 6) AS s, round(pow(p_size, 2), 3) AS p, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10,
       round(exp(p_size / 50.0), 6) AS e, greatest(p_size, 10) AS g, least(p_size, 10) AS m, sign(p_size - 25.0) AS sg FROM {part}""",
    """SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f,
       round(sqrt(p_retailprice), 6) AS s, round(pow(p_size, 2), 3) AS p, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10,
       round(exp(p_size / 50.0), 6) AS e, greatest(p_size, 10) AS g, least(p_size, 10) AS m, sign(p_size - 25.0)::DOUBLE AS sg FROM part""",
)
register_sql(
    "fn_division_null",
    "SELECT p_partkey, try_divide(p_retailprice, p_size % 3) AS q, try_mod(p_size, p_size % 3) AS m FROM {part}",
    "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice / (p_size % 3) END AS q, CASE WHEN p_size % 3 <> 0 THEN p_size % (p_size % 3) END AS m FROM part",
)
register_sql(
    "fn_datetime",
    """SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h,
       CAST(minute(ts) AS BIGINT) AS mi, CAST(dayofweek(ts) - 1 AS BIGINT) AS dow, unix_seconds(CAST(ts AS TIMESTAMP)) AS s, unix_millis(CAST(ts AS TIMESTAMP)) AS ms,
       date_trunc('month', ts) AS m0, date_trunc('hour', ts) AS h0, ts + INTERVAL 36 HOURS AS later, ts - INTERVAL 1 DAY AS before FROM {events}""",
    """SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) AS dow,
       floor(epoch_us(ts) / 1000000)::BIGINT AS s, floor(epoch_us(ts) / 1000)::BIGINT AS ms, date_trunc('month', ts)::TIMESTAMP AS m0, date_trunc('hour', ts) AS h0,
       ts + INTERVAL 36 HOUR AS later, ts - INTERVAL 1 DAY AS before FROM events""",
)
register_sql(
    "fn_json",
    """SELECT event_id, get_json_object(props, '$.k') AS k, json_array_length('[1,2,3]') AS n FROM {events}""",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, 3 AS n FROM events""",
)


@register("fn_json_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def _keys(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.sort_array(F.json_object_keys("props")), ",").alias("keys"))


register_sql(
    "fn_array",
    """SELECT vec_id, size(a) AS n, array_contains(a, 2) AS has, nullif(array_position(a, 3), 0) AS pos, array_join(array_distinct(a), ',') AS dist,
       array_join(reverse(a), ',') AS rev, array_join(array_remove(a, 1), ',') AS rem, array_join(array_append(a, 9), ',') AS app
       FROM (SELECT vec_id, array(CAST(label AS INT), 1, 3, 1) AS a FROM {embeddings})""",
    """SELECT vec_id, 4 AS n, list_contains(a, 2) AS has, nullif(list_position(a, 3), 0)::BIGINT AS pos,
       concat_ws(',', label, CASE WHEN label <> 1 THEN '1' END, CASE WHEN label <> 3 THEN '3' END) AS dist,
       array_to_string(list_reverse(a), ',') AS rev, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS rem,
       array_to_string(list_append(a, 9), ',') AS app FROM (SELECT vec_id, label, [label::INT, 1, 3, 1] AS a FROM embeddings)""",
)
register_sql(
    "fn_array_predicates",
    """SELECT vec_id, array_contains(a, 3) AS c, size(array_except(array(1, 3), a)) = 0 AS all_in, arrays_overlap(a, array(7, 8)) AS o
       FROM (SELECT vec_id, array(CAST(label AS INT), 1, 3) AS a FROM {embeddings})""",
    """SELECT vec_id, true AS c, true AS all_in, label IN (7, 8) AS o FROM embeddings""",
)
register_sql(
    "fn_conditional",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, greatest(c_acctbal, 0) AS g, least(c_acctbal, 0, NULL) AS l FROM {customer}",
)
register_sql(
    "fn_try_cast",
    "SELECT c_custkey, try_cast(c_mktsegment AS INT) AS bad, try_cast(CAST(c_custkey AS STRING) AS INT) AS good FROM {customer}",
    "SELECT c_custkey, try_cast(c_mktsegment AS INT) AS bad, try_cast(c_custkey::VARCHAR AS INT) AS good FROM customer",
)


@register("fn_round_modes", """SELECT l_orderkey, l_linenumber, trunc(v) AS tr, CASE WHEN v < 0 THEN floor(v) ELSE ceil(v) END AS away, floor(v) AS fl, round_even(v, 0) AS even
  FROM (SELECT l_orderkey, l_linenumber, l_quantity / 2 - 10 AS v FROM lineitem)""")
def _round(spark, d):
    v = F.col("l_quantity") / 2 - 10
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.round_mode(v, 0, "TRUNCATE").alias("tr"), fn.round_mode(v, 0, "CEILING").alias("away"),
        fn.round_mode(v, 0, "FLOOR").alias("fl"), fn.round_mode(v, 0).alias("even"),
    )


@register("fn_id_kinds", "SELECT 'uuid4' AS k, true AS ok UNION ALL SELECT 'ulid', true UNION ALL SELECT 'plain', true")
def _ids(spark, d):
    rows = [("uuid4", "9b2f7c1e-4a55-4d0c-8c11-0a2b3c4d5e6f", "uuid"), ("ulid", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "ulid"), ("plain", "hello world", "unknown")]
    return spark.createDataFrame(rows, "k string, v string, want string").select("k", (fn.id_type(F.col("v")) == F.col("want")).alias("ok"))


@register("fn_time_bucket", "SELECT event_id, (epoch_us(ts) // 900000000) * 900000 AS at FROM events")
def _time_bucket(spark, d):
    return table(spark, d, "events").select("event_id", fn.time_bucket_ms(F.col("ts"), "15m").alias("at"))


@register("fn_date_diff", "SELECT a.o_orderkey, round((epoch_us(a.o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 1e6, 3) AS s FROM orders a")
def _diff(spark, d):
    at = F.lit("1995-01-01").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.round(fn.date_diff(F.col("o_orderdate"), at), 3).alias("s"))


register_sql(
    "fn_trim_split",
    """SELECT c_custkey, ltrim(concat('  ', c_name, ' ')) AS l, rtrim(concat('  ', c_name, ' ')) AS r, split(c_name, '#')[0] AS head,
       size(split(c_name, '#')) AS parts FROM {customer}""",
    """SELECT c_custkey, ltrim(concat('  ', c_name, ' ')) AS l, rtrim(concat('  ', c_name, ' ')) AS r, string_split(c_name, '#')[1] AS head,
       len(string_split(c_name, '#'))::INT AS parts FROM customer""",
)
register_sql(
    "fn_log2_decimal",
    "SELECT p_partkey, round(log2(p_retailprice), 9) AS l2, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING) AS d FROM {part}",
    "SELECT p_partkey, round(log2(p_retailprice), 9) AS l2, p_retailprice::DECIMAL(18, 2)::VARCHAR AS d FROM part",
)
register_sql(
    "fn_date_parts",
    """SELECT event_id, CAST(floor(date_part('second', ts)) AS BIGINT) AS s, CAST(date_part('second', ts) * 1000000 AS BIGINT) AS us,
       to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS parsed, timestamp_micros(1704067200000000 + event_id) AS from_micros,
       date_format(ts, 'yyyy/MM/dd') AS shown FROM {events}""",
    """SELECT event_id, second(ts) AS s, microsecond(ts) AS us, date_trunc('second', ts)::TIMESTAMP AS parsed,
       make_timestamp(1704067200000000 + event_id) AS from_micros, strftime(ts, '%Y/%m/%d') AS shown FROM events""",
)
register_sql(
    "fn_array_build",
    """SELECT vec_id, array_join(array_prepend(a, 9), ',') AS pre, array_join(concat(a, array(7, 8)), ',') AS cat, array_join(array_sort(array_union(a, array(7))), ',') AS uni,
       typeof(a) AS kind FROM (SELECT vec_id, array(5, 1, 3) AS a FROM {embeddings})""",
    "SELECT vec_id, '9,5,1,3' AS pre, '5,1,3,7,8' AS cat, '1,3,5,7' AS uni, 'array<int>' AS kind FROM embeddings",
)


@register("fn_json_build", """SELECT o_orderkey, json_type(d) AS kind, (d->>'k')::BIGINT AS k, d->>'s' AS s, 3 AS n, 'ARRAY' AS array_kind FROM
  (SELECT o_orderkey, json_object('k', o_orderkey, 's', o_orderstatus) AS d FROM orders)""")
def _json_build(spark, d):
    doc = js.json_object(k=F.col("o_orderkey"), s=F.col("o_orderstatus"))
    arr = js.json_array(F.lit(1), F.lit(2), F.col("o_orderkey"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.upper(js.json_type(doc)).alias("kind"), F.get_json_object(doc, "$.k").cast("long").alias("k"),
        F.get_json_object(doc, "$.s").alias("s"), F.json_array_length(arr).alias("n"), F.upper(js.json_type(arr)).alias("array_kind"),
    )


@register("fn_json_edit", """SELECT o_orderkey, o_orderkey + 1 AS k, o_orderstatus AS s, NULL::VARCHAR AS gone, o_orderstatus AS kept, 'new' AS merged, o_orderstatus = 'F' AS has
  FROM orders""")
def _json_edit(spark, d):
    doc = js.json_object(k=F.col("o_orderkey"), s=F.col("o_orderstatus"))
    changed = js.json_set(doc, "k", (F.col("o_orderkey") + 1).cast("string"))
    removed, merged = js.json_remove(doc, "k"), js.json_merge(doc, F.lit('{"k":"new"}'))
    get = F.get_json_object
    return table(spark, d, "orders").select(
        "o_orderkey", get(changed, "$.k").cast("long").alias("k"), get(changed, "$.s").alias("s"), get(removed, "$.k").alias("gone"),
        get(removed, "$.s").alias("kept"), get(merged, "$.k").alias("merged"), js.json_contains(doc, F.lit('{"s":"F"}')).alias("has"),
    )


@register("fn_uuid", "SELECT count(*) AS n, count(*) AS valid, count(*) AS distinct_ids FROM orders")
def _uuid(spark, d):
    ids = table(spark, d, "orders").select(F.expr("uuid()").alias("u"))
    return ids.agg(F.count("*").alias("n"), F.count(F.when(fn.is_uuid(F.col("u")), 1)).alias("valid"), F.countDistinct("u").alias("distinct_ids"))
