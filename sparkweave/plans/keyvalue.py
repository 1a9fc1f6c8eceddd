"""Key-value and leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import kv as op

_NOW = "TIMESTAMP '1996-06-01'"


def _store(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"),
    )


_S = "s AS (SELECT o_orderkey AS key, o_totalprice AS value, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS expires_at FROM orders)"


@register("kv_live", f"WITH {_S} SELECT key, value FROM s WHERE expires_at IS NULL OR expires_at > {_NOW}")
def _live(spark, d):
    return op.live(_store(spark, d), F.lit("1996-06-01").cast("timestamp")).select("key", "value")


@register("kv_ttl", f"WITH {_S} SELECT key, coalesce((epoch_us(expires_at) - epoch_us({_NOW})) // 1000, -1) AS ttl_ms FROM s WHERE expires_at IS NULL OR expires_at > {_NOW}")
def _ttl(spark, d):
    return op.ttl(_store(spark, d), F.lit("1996-06-01").cast("timestamp"))


@register("kv_batch_get", f"WITH {_S} SELECT key, value FROM s WHERE key IN (1, 5, 9, 77777777)")
def _batch(spark, d):
    return _store(spark, d).filter(F.col("key").isin(1, 5, 9, 77777777)).select("key", "value")


@register("kv_fold_log", """WITH l AS (SELECT user_id AS key, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'SET' WHEN 1 THEN 'DEL' ELSE 'INCR' END AS op, event_id % 100 AS value FROM events),
  b AS (SELECT key, arg_max(op, seq) AS bop, arg_max(value, seq) AS bv, max(seq) AS bat FROM l WHERE op <> 'INCR' GROUP BY key),
  m AS (SELECT l.key, sum(value) FILTER (WHERE op = 'INCR' AND (bat IS NULL OR seq > bat))::BIGINT AS more, any_value(bop) AS bop, any_value(bv) AS bv FROM l LEFT JOIN b ON l.key = b.key GROUP BY l.key)
  SELECT key, CASE WHEN more IS NULL THEN bv ELSE CASE WHEN bop = 'SET' THEN bv ELSE 0 END + more END AS value FROM m WHERE more IS NOT NULL OR bop = 'SET'""")
def _fold(spark, d):
    k = F.col("event_id") % 5
    log = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(k == 0, "SET").when(k == 1, "DEL").otherwise("INCR").alias("op"),
        (F.col("event_id") % 100).alias("value"),
    )
    return op.fold(log, "seq")


@register("kv_leaderboard", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer QUALIFY rank <= 15")
def _board(spark, d):
    return op.board(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 15)


@register("kv_rank_of", "SELECT count(*) + 1 AS rank FROM customer WHERE (c_acctbal, -c_custkey) > (SELECT (c_acctbal, -c_custkey) FROM customer WHERE c_custkey = 42)")
def _rank(spark, d):
    return op.rank_of(table(spark, d, "customer"), "c_acctbal", "c_custkey", 42)


@register("kv_score_range_count", "SELECT count(*) AS n FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000")
def _range(spark, d):
    return table(spark, d, "customer").filter(F.col("c_acctbal").between(1000, 5000)).agg(F.count("*").alias("n"))


@register("kv_rate_gate", """SELECT event_id, count(*) OVER w AS used, count(*) OVER w <= 2 AS allowed FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def _rate(spark, d):
    return op.rate(table(spark, d, "events"), "user_id", "ts", 86400, 2).select("event_id", "used", "allowed")
