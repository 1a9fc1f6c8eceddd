"""PromQL range queries over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import promql as op

START, END, STEP, WIDTH = 1704067200, 1704067200 + 20 * 86400, 86400, 2 * 86400
_G = f"""s AS (SELECT event_type, ts, value, event_id FROM events), g AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS step),
  w AS (SELECT event_type, step, epoch_us(ts) AS t, ts, value FROM s JOIN g ON epoch_us(ts) <= step * 1000000 AND epoch_us(ts) > (step - {WIDTH}) * 1000000),
  o AS (SELECT *, lag(value) OVER z AS p FROM w WINDOW z AS (PARTITION BY event_type, step ORDER BY t, value))"""
_F = {
    "avg_over_time": "avg(value)", "sum_over_time": "sum(value)", "min_over_time": "min(value)", "max_over_time": "max(value)",
    "count_over_time": "count(value)::DOUBLE", "stddev_over_time": "stddev_pop(value)", "quantile_over_time_0.9": "quantile_cont(value, 0.9)",
}
_O = {
    "increase": "sum(CASE WHEN value < p THEN value ELSE value - p END)", "rate": f"sum(CASE WHEN value < p THEN value ELSE value - p END) / {WIDTH}",
    "delta": "arg_max(value, {'t': t, 'v': value}) - arg_min(value, {'t': t, 'v': value})",
    "changes": "(count(*) FILTER (WHERE value <> p))::DOUBLE", "resets": "(count(*) FILTER (WHERE value < p))::DOUBLE",
}
for _name, _sql in {**_F, **_O}.items():

    @register(f"promql_{_name.replace('.', '_')}", f"WITH {_G} SELECT event_type, step, round({_sql}, 6) AS value FROM o GROUP BY event_type, step" + (" HAVING count(*) > 1" if _name in _O else ""))
    def _range(spark, d, name=_name):
        out = op.over_time(table(spark, d, "events"), ["event_type"], name, START, END, STEP, WIDTH)
        return out.select("event_type", F.col("step").cast("long").alias("step"), F.round("value", 6).alias("value"))


@register("promql_sum_by", f"WITH {_G}, a AS (SELECT event_type, step, avg(value) AS v FROM w GROUP BY ALL) SELECT step, round(sum(v), 6) AS value FROM a GROUP BY step")
def _sum_by(spark, d):
    v = op.over_time(table(spark, d, "events"), ["event_type"], "avg_over_time", START, END, STEP, WIDTH)
    return op.aggregate(v, [], "sum").select(F.col("step").cast("long").alias("step"), F.round("value", 6).alias("value"))


@register("promql_instant", f"WITH {_G} SELECT event_type, step, arg_max(value, {{'t': t, 'v': value}}) AS value FROM w WHERE t > (step - 43200) * 1000000 GROUP BY event_type, step")
def _instant(spark, d):
    out = op.instant(table(spark, d, "events"), ["event_type"], START, END, STEP, 43200)
    return out.withColumn("step", F.col("step").cast("long"))


@register("promql_binary_ratio", f"WITH {_G} SELECT event_type, step, round(max(value) / avg(value), 6) AS value FROM w GROUP BY event_type, step")
def _binary(spark, d):
    e = table(spark, d, "events")
    a, b = (op.over_time(e, ["event_type"], f, START, END, STEP, WIDTH) for f in ("max_over_time", "avg_over_time"))
    return op.binary(a, b, ["event_type"], "/").select("event_type", F.col("step").cast("long").alias("step"), F.round("value", 6).alias("value"))


def _vector(spark, d, function="avg_over_time"):
    return op.over_time(table(spark, d, "events"), ["event_type"], function, START, END, STEP, WIDTH).withColumn("step", F.col("step").cast("long"))


def _six(df):
    return df.withColumn("value", F.round("value", 6))


_A = f"{_G}, a AS (SELECT event_type, step, avg(value) AS v FROM w GROUP BY ALL)"
_MATH = {
    "abs": "abs(v)", "ceil": "ceil(v)", "floor": "floor(v)", "sqrt": "sqrt(v)", "exp": "exp(v)", "ln": "ln(v)", "log2": "log2(v)",
    "log10": "log10(v)", "sgn": "sign(v)::DOUBLE", "deg": "degrees(v)", "rad": "radians(v)", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)",
    "asin": "asin(v)", "acos": "acos(v)",
}
for _name, _sql in _MATH.items():
    _scale = "/ 100" if _name in ("asin", "acos", "exp") else ""

    @register(f"promql_{_name}", f"WITH {_A} SELECT event_type, step, round({_sql}, 6) AS value FROM (SELECT event_type, step, least(abs(v {_scale}), {1 if _name in ('asin', 'acos') else 1e18}) AS v FROM a)")
    def _math(spark, d, name=_name, scale=_scale):
        top = 1.0 if name in ("asin", "acos") else 1e18
        v = _vector(spark, d).withColumn("value", F.least(F.abs(F.col("value") / (100 if scale else 1)), F.lit(top)))
        return _six(op.math(v, name))


@register("promql_clamp", f"WITH {_A} SELECT event_type, step, round(least(greatest(v, 40), 60), 6) AS value FROM a")
def _clamp(spark, d):
    return _six(op.clamp(_vector(spark, d), 40, 60))


@register("promql_round", f"WITH {_A} SELECT event_type, step, floor(v / 5 + 0.5) * 5 AS value FROM a")
def _rounded(spark, d):
    return op.rounded(_vector(spark, d), 5)


@register("promql_label_replace", f"WITH {_A} SELECT event_type, step, CASE WHEN regexp_full_match(event_type, '(.)(.*)') THEN regexp_replace(event_type, '^(.)(.*)$', '\\2-\\1') ELSE '' END AS kind, round(v, 6) AS value FROM a")
def _replace(spark, d):
    return _six(op.label_replace(_vector(spark, d), "kind", "$2-$1", "event_type", "(.)(.*)"))


@register("promql_label_join", f"WITH {_A} SELECT event_type, step, concat_ws('/', event_type, event_type) AS twice, round(v, 6) AS value FROM a")
def _join(spark, d):
    return _six(op.label_join(_vector(spark, d), "twice", "/", "event_type", "event_type"))


@register("promql_topk", f"WITH {_A} SELECT event_type, step, round(v, 6) AS value FROM a QUALIFY row_number() OVER (PARTITION BY step ORDER BY v DESC, event_type) <= 2")
def _topk(spark, d):
    return _six(op.topk(_vector(spark, d), [], ["event_type"], 2))


@register("promql_bottomk", f"WITH {_A} SELECT event_type, step, round(v, 6) AS value FROM a QUALIFY row_number() OVER (PARTITION BY step ORDER BY v, event_type) <= 1")
def _bottomk(spark, d):
    return _six(op.topk(_vector(spark, d), [], ["event_type"], 1, largest=False))


@register("promql_quantile", f"WITH {_A} SELECT step, round(quantile_cont(v, 0.75), 6) AS value FROM a GROUP BY step")
def _quantile(spark, d):
    return _six(op.quantile(_vector(spark, d), [], 0.75))


@register("promql_count_values", f"WITH {_G}, a AS (SELECT event_type, step, count(value)::DOUBLE AS v FROM w GROUP BY ALL) SELECT v AS n, step, count(*)::DOUBLE AS value FROM a GROUP BY ALL")
def _count_values(spark, d):
    out = op.count_values(_vector(spark, d, "count_over_time"), [], "n")
    return out.withColumn("n", F.col("n").cast("double"))


@register("promql_selector_offset", f"""WITH {_G} SELECT event_type, step, (count(*))::DOUBLE AS value FROM
  (SELECT event_type, step, epoch_us(ts) + 86400000000 AS t FROM s, g WHERE event_type <> 'click' AND regexp_full_match(event_type, '[a-z]+'))
  WHERE t <= step * 1000000 AND t > (step - {WIDTH}) * 1000000 GROUP BY event_type, step""")
def _selector(spark, d):
    some = op.select(table(spark, d, "events"), [("event_type", "!=", "click"), ("event_type", "=~", "[a-z]+")], 86400)
    return op.over_time(some, ["event_type"], "count_over_time", START, END, STEP, WIDTH).withColumn("step", F.col("step").cast("long"))


@register("promql_absent_over_time", f"WITH {_G} SELECT step, 1.0::DOUBLE AS value FROM g WHERE step NOT IN (SELECT step FROM w WHERE event_type = 'purchase' AND value > 80)")
def _absent(spark, d):
    some = op.select(table(spark, d, "events"), [("event_type", "=", "purchase")]).filter("value > 80")
    return op.absent(op.over_time(some, ["event_type"], "count_over_time", START, END, STEP, WIDTH), START, END, STEP)


@register("promql_predict_linear", f"""WITH {_G} SELECT event_type, step, round(arg_max(value, {{'t': t, 'v': value}}) + regr_slope(value, t / 1e6 - {START}) * 3600, 4) AS value
  FROM w GROUP BY event_type, step HAVING regr_slope(value, t / 1e6 - {START}) IS NOT NULL""")
def _predict(spark, d):
    out = op.predict_linear(table(spark, d, "events"), ["event_type"], 3600, START, END, STEP, WIDTH)
    return out.select("event_type", F.col("step").cast("long").alias("step"), F.round("value", 4).alias("value"))


@register("promql_holt_winters")
def _smoothed(spark, d):
    out = op.holt_winters(table(spark, d, "events"), ["event_type"], 0.3, 0.1, START, END, STEP, WIDTH)
    return _six(out.withColumn("step", F.col("step").cast("long")))


for _name, _sql in {
    "stdvar_over_time": "var_pop(value)", "last_over_time": "arg_max(value, {'t': t, 'v': value})", "deriv": f"regr_slope(value, t / 1e6 - {START})",
    "idelta": "arg_max(value - p, {'t': t, 'v': value})",
}.items():

    @register(f"promql_{_name}", f"WITH {_G} SELECT event_type, step, round({_sql}, 6) AS value FROM o GROUP BY event_type, step" + (" HAVING count(*) > 1" if _name == "idelta" else ""))
    def _more(spark, d, name=_name):
        return _six(_vector(spark, d, name))


@register("promql_histogram_quantile", f"""WITH {_G}, b AS (SELECT step, le, (count(*) FILTER (WHERE value <= le))::DOUBLE AS n FROM w, (SELECT unnest([20.0, 40.0, 60.0, 80.0, 'inf'::DOUBLE]) AS le) GROUP BY step, le),
  r AS (SELECT *, lag(n, 1, 0) OVER z AS before, lag(le, 1, 0) OVER z AS low, 0.5 * max(n) OVER (PARTITION BY step) AS rank FROM b WINDOW z AS (PARTITION BY step ORDER BY le))
  SELECT step, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS value
  FROM r WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY step ORDER BY le) = 1""")
def _histogram(spark, d):
    w = table(spark, d, "events").withColumn("step", F.explode(op._steps(F.col("ts"), START, END, STEP, WIDTH)))
    le = F.explode(F.array(*[F.lit(x) for x in (20.0, 40.0, 60.0, 80.0, float("inf"))]))
    counts = w.withColumn("le", le).groupBy("step", "le").agg(F.count(F.when(F.col("value") <= F.col("le"), 1)).cast("double").alias("value"))
    return _six(op.histogram_quantile(0.5, counts, []).withColumn("step", F.col("step").cast("long")))
