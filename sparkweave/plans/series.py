"""Time-series, temporal and window-analytics queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import register, register_sql, table
from ..functions import series as ts
from ..operators import timeseries as op


@register(
    "ts_bucket_5m_by_type",
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total
       FROM events GROUP BY 1, 2""",
)
def _bucket5(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(op.bucket(F.col("ts"), "5 minutes").alias("bucket"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@register("ts_bucket_1h", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _bucket1h(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(op.bucket(F.col("ts"), "1 hour").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


register_sql("ts_group_by_type", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
register_sql("ts_group_by_user", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY user_id")
register_sql("ts_filter_count", "SELECT count(*) AS n FROM {events} WHERE event_type = 'click'")
register_sql(
    "ts_last_value",
    "SELECT user_id, max_by(value, struct(ts, event_id)) AS value FROM {events} GROUP BY user_id",
    "SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id",
)
register_sql("ts_tag_autocomplete", "SELECT DISTINCT event_type FROM {events} WHERE event_type LIKE 'p%'")

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, d):
    return table(spark, d, "events"), W.partitionBy("user_id").orderBy("ts", "event_id")


@register(
    "ts_rate_delta_derivative",
    f"""SELECT event_id, round(CASE WHEN dt > 0 THEN CASE WHEN value < p THEN value ELSE value - p END / dt END, 6) AS rate,
        round(value - p, 6) AS delta, round(CASE WHEN dt > 0 THEN (value - p) / dt END, 6) AS derivative
        FROM (SELECT *, lag(value) OVER w AS p, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt FROM events {_W})""",
)
def _rates(spark, d):
    e, w = _events(spark, d)
    v, t = F.col("value"), F.col("ts")
    return e.select(
        "event_id", F.round(ts.rate(v, t, w), 6).alias("rate"), F.round(ts.delta(v, w), 6).alias("delta"),
        F.round(ts.derivative(v, t, w), 6).alias("derivative"),
    )


_FRAME = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@register(
    "ts_moving_avg_zscore_bollinger",
    f"""SELECT event_id, CASE WHEN n = 4 THEN round(m, 6) END AS ma,
        CASE WHEN n = 4 THEN CASE WHEN sd = 0 THEN 0 ELSE round((value - m) / sd, 6) END END AS z,
        CASE WHEN n = 4 THEN round(m + 2 * sd, 6) END AS upper, CASE WHEN n = 4 THEN round(m - 2 * sd, 6) END AS lower,
        CASE WHEN n = 4 THEN round(q, 6) END AS mp
        FROM (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd,
              quantile_cont(value, 0.75) OVER w AS q FROM events WINDOW w AS {_FRAME})""",
)
def _moving(spark, d):
    e, w = _events(spark, d)
    v = F.col("value")
    b = ts.bollinger(v, w, 4, 2.0)
    return e.select(
        "event_id", F.round(ts.moving_avg(v, w, 4), 6).alias("ma"), F.round(ts.zscore(v, w, 4), 6).alias("z"),
        F.round(b["upper"], 6).alias("upper"), F.round(b["lower"], 6).alias("lower"),
        F.round(ts.moving_percentile(v, w, 4, 0.75), 6).alias("mp"),
    )


@register(
    "ts_ema",
    """WITH RECURSIVE h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
       o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM h),
       r AS (SELECT event_type, i, v AS e FROM o WHERE i = 1
             UNION ALL SELECT o.event_type, o.i, 0.3 * o.v + 0.7 * r.e FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
       SELECT event_type, i::BIGINT AS i, round(e, 6) AS ema FROM r""",
)
def _ema(spark, d):
    days = table(spark, d, "events").groupBy(op.bucket(F.col("ts"), "1 day").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    per = days.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "v"))).alias("s"))
    per = per.select("event_type", F.posexplode(ts.ema(F.col("s.v"), 0.3)).alias("i", "ema"))
    return per.select("event_type", (F.col("i") + 1).cast("long").alias("i"), F.round("ema", 6).alias("ema"))


@register(
    "ts_interpolate_linear",
    """WITH x AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
       g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS pt,
             first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS nt
             FROM x WINDOW b AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                           a AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT event_id, round(coalesce(v, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * ((epoch_us(ts) - pt) / 1e6) / ((nt - pt) / 1e6) END), 4) AS v FROM g""",
)
def _interpolate(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    e = e.withColumn("series", F.lit("all"))
    return op.interpolate(e, "ts", "v", ["series"], "event_id").select("event_id", F.round("v", 4).alias("v"))


@register(
    "ts_interpolate_linear_by_type",
    """WITH x AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
       g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS pt,
             first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS nt
             FROM x WINDOW b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                           a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT event_id, round(coalesce(v, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * ((epoch_us(ts) - pt) / 1e6) / ((nt - pt) / 1e6) END), 4) AS v FROM g""",
)
def _interpolate_by_type(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return op.interpolate(e, "ts", "v", ["event_type"], "event_id").select("event_id", F.round("v", 4).alias("v"))


@register(
    "ts_downsample",
    """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum,
       count(value) AS count, arg_min(value, {'t': ts, 'v': value}) AS first, arg_max(value, {'t': ts, 'v': value}) AS last
       FROM events GROUP BY 1, 2""",
)
def _downsample(spark, d):
    return op.downsample(table(spark, d, "events"), "ts", "value", "6 hours", ["event_type"]).withColumn("sum", F.round("sum", 4))


_GRID = """WITH b AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS tick, avg(value) AS v FROM events GROUP BY 1, 2),
  s AS (SELECT *, lead(tick) OVER w AS nx, lead(v) OVER w AS nv FROM b WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
  g AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [tick] ELSE generate_series(tick, nx - INTERVAL 1 HOUR, INTERVAL 1 HOUR) END) AS x FROM s)"""

for _how, _fill in {
    "null": "NULL", "prev": "v", "constant": "0",
    "linear": "v + (nv - v) * ((epoch_us(x) - epoch_us(tick))::DOUBLE / (epoch_us(nx) - epoch_us(tick)))",
}.items():

    @register(f"ts_gap_fill_{_how}", f"{_GRID} SELECT event_type, x AS tick, round(CASE WHEN x = tick THEN v ELSE {_fill} END, 6) AS v FROM g")
    def _gaps(spark, d, how=_how):
        e = table(spark, d, "events").groupBy("event_type", op.bucket(F.col("ts"), "1 hour").alias("tick")).agg(F.avg("value").alias("v"))
        return op.gap_fill(e, "tick", "v", "1 hour", ["event_type"], how).withColumn("v", F.round("v", 6))


_ASOF = """WITH r AS (SELECT o_custkey AS k, o_orderdate AS ts, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
  l AS (SELECT event_id, user_id AS k, ts FROM events)
  SELECT l.event_id, {} AS o_orderkey FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts"""


def _asof(spark, d, tolerance):
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    left = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    out = op.asof_join(left, right, "ts", ["k"], ["o_orderkey"], tolerance, "30 days")
    return out.select("event_id", "o_orderkey")


@register("join_asof_keyed", _ASOF.format("r.o_orderkey"))
def _asof_all(spark, d):
    return _asof(spark, d, None)


@register("join_asof_tolerance", _ASOF.format("CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 8640000000000000 THEN r.o_orderkey END"))
def _asof_near(spark, d):
    return _asof(spark, d, 8640000000000)


@register(
    "ts_tier_union",
    """SELECT ts AS tick, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL
       SELECT time_bucket(INTERVAL 1 DAY, ts), round(sum(value), 4) FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1""",
)
def _tiers(spark, d):
    e = table(spark, d, "events")
    days = e.groupBy(op.bucket(F.col("ts"), "1 day").alias("tick")).agg(F.round(F.sum("value"), 4).alias("v"))
    cut = "2024-01-15 00:00:00"
    return op.tiers([(e.select(F.col("ts").alias("tick"), F.col("value").alias("v")), cut, None), (days, None, cut)], "tick")


_VERSIONS = """v AS (SELECT o_custkey AS k, o_orderkey AS sys, o_totalprice AS price, o_orderkey % 50 AS vf,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 + 20 END AS vt, o_orderstatus = 'P' AS gone FROM orders)"""


def _versions(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("sys"), F.col("o_totalprice").alias("price"),
        (F.col("o_orderkey") % 50).alias("vf"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50 + 20).alias("vt"),
        (F.col("o_orderstatus") == "P").alias("gone"),
    )


@register(
    "temporal_as_of",
    f"""WITH {_VERSIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sys DESC) AS rn FROM v WHERE sys <= 1000)
        SELECT k, sys, price FROM l WHERE rn = 1 AND NOT gone AND vf <= 30 AND coalesce(vt > 30, true)""",
)
def _as_of(spark, d):
    out = op.as_of(_versions(spark, d), ["k"], "sys", F.lit(1000), ("vf", "vt"), F.lit(30), "gone")
    return out.select("k", "sys", "price")


@register(
    "temporal_as_of_fallback",
    f"""WITH {_VERSIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sys DESC) AS rn FROM v
          WHERE sys <= 1000 AND (gone OR vf <= 30 AND coalesce(vt > 30, true)))
        SELECT k, sys, price FROM l WHERE rn = 1 AND NOT gone""",
)
def _as_of_cells(spark, d):
    out = op.as_of(_versions(spark, d), ["k"], "sys", F.lit(1000), ("vf", "vt"), F.lit(30), "gone", skip_invalid=True)
    return out.select("k", "sys", "price")


register_sql(
    "temporal_lookup",
    """SELECT user_id, max_by(value, struct(ts, event_id)) AS value FROM {events} WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY user_id""",
    "SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY user_id",
)
register_sql(
    "balance_as_of",
    """SELECT c.c_custkey, round(max(c.c_acctbal) - coalesce(sum(o.o_totalprice), 0), 2) AS balance FROM {customer} c
       LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderdate > TIMESTAMP '1997-01-01' GROUP BY c.c_custkey""",
)


@register(
    "alert_hysteresis",
    """WITH d AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS tick, avg(value) AS v FROM events GROUP BY 1, 2),
       t AS (SELECT avg(value) AS m FROM events),
       b AS (SELECT d.*, v > m AS b FROM d, t),
       e AS (SELECT *, CASE WHEN lag(b) OVER w IS DISTINCT FROM b THEN 1 ELSE 0 END AS g FROM b WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
       r AS (SELECT *, sum(g) OVER (PARTITION BY event_type ORDER BY tick) AS run FROM e),
       n AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY tick) AS n FROM r),
       m AS (SELECT *, CASE WHEN b AND n >= 2 THEN 'FIRING' WHEN NOT b AND n >= 3 THEN 'OK' END AS mk FROM n)
       SELECT event_type, tick, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY tick
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'OK') AS state FROM m""",
)
def _alerts(spark, d):
    e = table(spark, d, "events")
    days = e.groupBy("event_type", op.bucket(F.col("ts"), "1 day").alias("tick")).agg(F.avg("value").alias("v"))
    days = days.join(F.broadcast(e.agg(F.avg("value").alias("m"))))
    return op.breaches(days, ["event_type"], "tick", F.col("v") > F.col("m"), 2, 3).select("event_type", "tick", "state")


@register("ts_stddev", "SELECT user_id, round(stddev_samp(value), 6) AS deviation, count(value) AS n FROM events GROUP BY user_id")
def _stddev(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.stddev_samp("value"), 6).alias("deviation"), F.count("value").alias("n"))


@register("ts_out_of_order_dedup", """SELECT user_id, date_trunc('hour', ts) AS slot, max(event_id) AS event_id, arg_max(value, event_id) AS value
  FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def _late_dedup(spark, d):
    e = table(spark, d, "events").withColumn("slot", F.date_trunc("hour", "ts"))
    last = e.groupBy("user_id", "slot").agg(F.max(F.struct("event_id", "value")).alias("m"))
    return last.select("user_id", "slot", "m.event_id", "m.value")


@register("ts_retention_tiers", """WITH m AS (SELECT max(ts) AS last FROM events),
  t AS (SELECT CASE WHEN ts > last - INTERVAL 1 DAY THEN 'raw' WHEN ts > last - INTERVAL 7 DAY THEN 'hour' ELSE 'day' END AS tier, ts, value FROM events, m)
  SELECT tier, CASE tier WHEN 'raw' THEN ts WHEN 'hour' THEN date_trunc('hour', ts) ELSE date_trunc('day', ts)::TIMESTAMP END AS at, count(*) AS n, round(sum(value), 6) AS total
  FROM t GROUP BY ALL""")
def _tiers(spark, d):
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("last"))))
    day = F.expr("INTERVAL 1 DAY")
    tier = F.when(F.col("ts") > F.col("last") - day, "raw").when(F.col("ts") > F.col("last") - day * 7, "hour").otherwise("day")
    at = F.when(F.col("tier") == "raw", F.col("ts")).when(F.col("tier") == "hour", F.date_trunc("hour", "ts")).otherwise(F.date_trunc("day", "ts"))
    return e.withColumn("tier", tier).groupBy("tier", at.alias("at")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@register("ts_sliding_window", """SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type,
    unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) for i in range(4)]) AS s FROM events) GROUP BY ALL""")
def _sliding(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@register("ts_session_window", """WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n FROM s GROUP BY user_id, s""")
def _session(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


@register("kv_leaderboard_windows", """WITH t AS (SELECT unit, CASE unit WHEN 'day' THEN date_trunc('day', ts) WHEN 'week' THEN date_trunc('week', ts) ELSE date_trunc('month', ts) END::TIMESTAMP AS start, user_id, value
    FROM events, (SELECT unnest(['day', 'week', 'month']) AS unit)),
  s AS (SELECT unit, start, user_id, round(sum(value), 6) AS score FROM t GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit, start ORDER BY score DESC, user_id)::INT AS place FROM s) WHERE place <= 3""")
def _leaderboards(spark, d):
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "ts").alias("start")) for u in ("day", "week", "month")]))
    s = table(spark, d, "events").select(units.alias("w"), "user_id", "value").groupBy("w.unit", "w.start", "user_id").agg(F.round(F.sum("value"), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("unit", "start").orderBy(F.desc("score"), "user_id"))
    return s.withColumn("place", place).filter("place <= 3")
