"""PromQL-style range evaluation over samples (series columns, ts, value) as joins of samples to a grid of steps.

A sample belongs to the steps whose window (step - range, step] holds it; those are computed from the sample
itself, so samples meet steps by explode and aggregation, without a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import micros

#: Seconds.
LOOKBACK = 300


def _steps(ts: Column, start: int, end: int, step: int, width: int) -> Column:
    """Steps at which a sample is in the window: start + k * step within [ts, ts + width)."""
    t = micros(ts)
    low = F.greatest(F.ceil((t - start * 1_000_000) / (step * 1_000_000)), F.lit(0))
    high = F.least(F.ceil((t + width * 1_000_000 - start * 1_000_000) / (step * 1_000_000)) - 1, F.lit((end - start) // step))
    return F.when(high >= low, F.transform(F.sequence(low, high), lambda k: start + k * step))


def instant(df: DataFrame, labels: list[str], start: int, end: int, step: int, lookback: int = LOOKBACK) -> DataFrame:
    """(labels, step, value): the last sample within the lookback at each step."""
    at = df.withColumn("step", F.explode(_steps(F.col("ts"), start, end, step, lookback)))
    return at.groupBy(*labels, "step").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def _gain(samples: Column) -> Column:
    """Counter increase over samples in time order: after a reset the new value is the increase."""
    pairs = F.zip_with(F.slice(samples, 1, F.size(samples) - 1), F.slice(samples, 2, F.size(samples) - 1), lambda a, b: F.when(b["value"] < a["value"], b["value"]).otherwise(b["value"] - a["value"]))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def over_time(df: DataFrame, labels: list[str], function: str, start: int, end: int, step: int, width: int) -> DataFrame:
    """(labels, step, value) of a range function: avg, sum, min, max, count, stddev, stdvar, last, quantile_<q> _over_time;
    increase, rate, irate, delta, idelta, deriv, changes, resets."""
    at = df.withColumn("step", F.explode(_steps(F.col("ts"), start, end, step, width)))
    simple = {
        "avg_over_time": F.avg("value"), "sum_over_time": F.sum("value"), "min_over_time": F.min("value"), "max_over_time": F.max("value"),
        "count_over_time": F.count("value").cast("double"), "stddev_over_time": F.stddev_pop("value"), "stdvar_over_time": F.var_pop("value"),
        "deriv": F.regr_slope("value", micros("ts") / 1e6 - start), "last_over_time": F.max_by("value", F.struct("ts", "value")),
    }
    if function.startswith("quantile_over_time_"):
        simple[function] = F.percentile("value", float(function.rsplit("_", 1)[1]))
    if function in simple:
        return at.groupBy(*labels, "step").agg(simple[function].alias("value"))
    s = F.col("_s")
    per = at.groupBy(*labels, "step").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_s")).filter(F.size("_s") >= 2)
    last, prior, first = F.element_at(s, -1), F.element_at(s, -2), F.element_at(s, 1)
    dt = (micros(last["ts"]) - micros(prior["ts"])) / 1e6
    count = lambda test: F.size(F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), test), lambda x: x)).cast("double")
    value = {
        "increase": _gain(s), "rate": _gain(s) / width, "delta": last["value"] - first["value"], "idelta": last["value"] - prior["value"],
        "irate": F.when(dt > 0, F.when(last["value"] < prior["value"], last["value"]).otherwise(last["value"] - prior["value"]) / dt),
        "changes": count(lambda a, b: a["value"] != b["value"]), "resets": count(lambda a, b: b["value"] < a["value"]),
    }[function]
    return per.select(*labels, "step", value.alias("value"))


def aggregate(vector: DataFrame, by: list[str], function: str) -> DataFrame:
    """sum, avg, min, max, count, stddev, stdvar or group by labels at each step."""
    f = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double"),
         "stddev": F.stddev_pop("value"), "stdvar": F.var_pop("value"), "group": F.max(F.lit(1.0))}[function]
    return vector.groupBy(*by, "step").agg(f.alias("value"))


def binary(a: DataFrame, b: DataFrame, on: list[str], op: str) -> DataFrame:
    """Arithmetic of two vectors that match on labels and step."""
    x, y = F.col("a.value"), F.col("b.value")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return a.alias("a").join(b.alias("b"), [*on, "step"]).select(*on, "step", value.alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, labels: list[str]) -> DataFrame:
    """(labels, step, value) from cumulative buckets (le, value), linear within the bucket that holds the quantile."""
    per = buckets.groupBy(*labels, "step").agg(F.sort_array(F.collect_list(F.struct("le", "value"))).alias("b"))
    b = F.col("b")
    rank = q * F.element_at(b, -1)["value"]
    i = F.size(F.filter(b, lambda x: x["value"] < rank))
    low = F.when(i > 0, F.get(b, i - 1)["le"]).otherwise(0.0)
    before = F.when(i > 0, F.get(b, i - 1)["value"]).otherwise(0.0)
    at = F.get(b, i)
    value = F.when(at["le"] == float("inf"), low).otherwise(low + (at["le"] - low) * (rank - before) / (at["value"] - before))
    return per.select(*labels, "step", value.alias("value"))


#: Names of the matcher operators.
MATCHERS = ("=", "!=", "=~", "!~")


def select(df: DataFrame, matchers: list[tuple[str, str, str]], offset: int = 0) -> DataFrame:
    """Samples whose labels meet every (label, operator, value); a missing label is empty. offset moves them later by seconds."""
    for label, how, value in matchers:
        if how not in MATCHERS:
            raise ValueError(how)
        x = F.coalesce(F.col(label), F.lit(""))
        met = x == value if how in ("=", "!=") else x.rlike(f"^(?:{value})$")
        df = df.filter(~met if how.startswith("!") else met)
    return df.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(offset))) if offset else df


def _logarithm(x: Column, log) -> Column:
    return F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).otherwise(F.lit(float("nan")))


MATH = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "sqrt": _root, "exp": F.exp,
    "ln": lambda x: _logarithm(x, F.log), "log2": lambda x: _logarithm(x, F.log2), "log10": lambda x: _logarithm(x, F.log10),
    "sgn": F.signum, "deg": F.degrees, "rad": F.radians, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
}


def math(vector: DataFrame, function: str) -> DataFrame:
    """vector with a function of MATH applied to its values."""
    return vector.withColumn("value", MATH[function](F.col("value")))


def rounded(vector: DataFrame, to: float = 1.0) -> DataFrame:
    """Values rounded to the nearest multiple of to, halves up."""
    return vector.withColumn("value", F.floor(F.col("value") / to + 0.5) * F.lit(float(to)))


def clamp(vector: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """clamp, clamp_min and clamp_max: values held between the bounds; nothing where low is above high."""
    x = F.col("value")
    if low is not None and high is not None and low > high:
        return vector.limit(0)
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return vector.withColumn("value", x)


def steps(df: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """The steps of an evaluation, as time() gives them."""
    at = df.sparkSession.range(start, end + 1, step).select(F.col("id").alias("step"))
    return at.withColumn("value", F.col("step").cast("double"))


def absent(vector: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """(step, 1) for the steps at which the vector has no element; over the result of a range function, absent_over_time."""
    at = steps(vector, start, end, step).withColumn("value", F.lit(1.0))
    return at.join(vector.select(F.col("step").cast("long").alias("step")).distinct(), "step", "left_anti")


def label_replace(vector: DataFrame, to: str, replacement: str, source: str, pattern: str) -> DataFrame:
    """Label `to` set to replacement, with groups of pattern as $1, where the whole source label matches; else left alone."""
    x = F.coalesce(F.col(source), F.lit(""))
    old = F.col(to) if to in vector.columns else F.lit("")
    new = F.regexp_replace(x, f"^(?:{pattern})$", replacement)
    return vector.withColumn(to, F.when(x.rlike(f"^(?:{pattern})$"), new).otherwise(old))


def label_join(vector: DataFrame, to: str, separator: str, *sources: str) -> DataFrame:
    return vector.withColumn(to, F.concat_ws(separator, *[F.coalesce(F.col(s), F.lit("")) for s in sources]))


def topk(vector: DataFrame, by: list[str], labels: list[str], k: int, largest: bool = True) -> DataFrame:
    """topk and bottomk: the k elements of each group and step with the largest or smallest values, ties by labels."""
    value = F.desc("value") if largest else F.asc("value")
    place = F.row_number().over(W.partitionBy(*by, "step").orderBy(value, *labels))
    return vector.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def quantile(vector: DataFrame, by: list[str], q: float) -> DataFrame:
    return vector.groupBy(*by, "step").agg(F.percentile("value", q).alias("value"))


def count_values(vector: DataFrame, by: list[str], label: str) -> DataFrame:
    """How many elements of each group and step have each value, which becomes a label."""
    named = vector.withColumn(label, F.col("value").cast("string"))
    return named.groupBy(*by, label, "step").agg(F.count("*").cast("double").alias("value"))


def predict_linear(df: DataFrame, labels: list[str], ahead: float, start: int, end: int, step: int, width: int) -> DataFrame:
    """(labels, step, value): the window's last value carried on for `ahead` seconds by the slope of its least-squares line."""
    at = df.withColumn("step", F.explode(_steps(F.col("ts"), start, end, step, width)))
    line = F.max_by("value", F.struct("ts", "value")) + F.regr_slope("value", micros("ts") / 1e6 - start) * ahead
    return at.groupBy(*labels, "step").agg(line.alias("value")).filter(F.col("value").isNotNull())


def holt_winters(df: DataFrame, labels: list[str], smooth: float, trend: float, start: int, end: int, step: int, width: int) -> DataFrame:
    """(labels, step, value): double exponential smoothing of the window's samples in time order."""
    at = df.withColumn("step", F.explode(_steps(F.col("ts"), start, end, step, width)))
    per = at.groupBy(*labels, "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("_v"))
    v = F.col("_v")

    def forward(acc: Column, x: Column) -> Column:
        level = smooth * x + (1 - smooth) * (acc["level"] + acc["slope"])
        return F.struct(level.alias("level"), (trend * (level - acc["level"]) + (1 - trend) * acc["slope"]).alias("slope"))

    begin = F.struct(F.get(v, 0).alias("level"), F.coalesce(F.get(v, 1) - F.get(v, 0), F.lit(0.0)).alias("slope"))
    value = F.aggregate(F.slice(v, 2, F.size(v)), begin, forward)["level"]
    return per.select(*labels, "step", value.alias("value"))
