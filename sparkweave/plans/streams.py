"""Change streams and incremental views, as batch queries of the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions.series import micros
from ..sources import line_protocol
from ..streaming import changes


@register("stream_view_by_window", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS at, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high,
  round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _view(spark, d):
    out = changes.view(table(spark, d, "events"), ["event_type"], "value", "ts", "1 day")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@register("cdc_field_diffs", """SELECT k, CASE WHEN n IS NULL THEN 'DELETE' WHEN o IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op FROM
  (SELECT coalesce(a.k, b.k) AS k, a.k AS o, b.k AS n, a.v AS ov, b.v AS nv FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0) a
   FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 7 <> 0) b ON a.k = b.k)
  WHERE o IS NULL OR n IS NULL OR ov <> nv""")
def _diffs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return changes.diff(c.filter("k % 5 <> 0"), new, ["k"]).select("k", "op")


@register("cdc_compaction", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_id % 4 <> 0""")
def _compact(spark, d):
    e = table(spark, d, "events").withColumn("op", F.when(F.col("event_id") % 4 == 0, "DELETE").otherwise("UPDATE"))
    return changes.compacted(e, ["user_id"], "event_id").select("user_id", "event_id")


@register("source_line_protocol", """SELECT event_type AS kind, user_id::VARCHAR AS user, round(value, 3) AS v, time_bucket(INTERVAL 1 MICROSECOND, ts) AS ts FROM events""")
def _ilp(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("ev,type="), "event_type", F.lit(",user="), F.col("user_id").cast("string"), F.lit(" value="), F.round("value", 3).cast("string"),
                    F.lit(",ok=true "), (micros("ts") * 1000).cast("string"))
    p = line_protocol.parse(e.select(line.alias("value")))
    return p.select(F.col("tags")["type"].alias("kind"), F.col("tags")["user"].alias("user"), F.col("fields")["value"].cast("double").alias("v"), "ts")
