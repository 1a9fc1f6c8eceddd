"""Buckets, gap filling, as-of joins, tiers and line-protocol helpers over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import micros


def bucket(ts: Column, width: str) -> Column:
    return F.window(ts, width).start


def downsample(df: DataFrame, ts: str, value: str, width: str, keys: list[str]) -> DataFrame:
    """min, max, sum, count, first and last of each bucket and key."""
    return df.groupBy(*keys, bucket(F.col(ts), width).alias("bucket")).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"),
        F.min_by(value, F.struct(ts, value)).alias("first"), F.max_by(value, F.struct(ts, value)).alias("last"),
    )


def gap_fill(df: DataFrame, at: str, value: str, width: str, keys: list[str], how: str = "null", constant: float = 0.0) -> DataFrame:
    """A row for every bucket between a key's first and last; value filled by null, prev, linear or constant.

    df has one row per key and bucket. Missing buckets are made from each gap's own two ends, so no key's
    whole range stands in one row.
    """
    w = W.partitionBy(*keys).orderBy(at)
    seen = df.select(*keys, at, value).withColumns({"_next": F.lead(at).over(w), "_to": F.lead(value).over(w)})
    step = F.expr(f"INTERVAL {width}")
    grid = F.when(F.col("_next").isNull(), F.array(at)).otherwise(F.sequence(at, F.col("_next") - step, step))
    out = seen.withColumn("_at", F.explode(grid))
    share = (micros("_at") - micros(at)) / (micros("_next") - micros(at))
    fills = {
        "null": F.lit(None).cast("double"),
        "prev": F.col(value),
        "constant": F.lit(constant),
        "linear": F.col(value) + (F.col("_to") - F.col(value)) * share,
    }
    filled = F.when(F.col("_at") == F.col(at), F.col(value)).otherwise(fills[how])
    return out.select(*keys, F.col("_at").alias(at), filled.alias(value))


def asof_join(
    left: DataFrame, right: DataFrame, on: str, keys: list[str], values: list[str], tolerance_ms: int | None = None,
    slice_width: str = "1 day",
) -> DataFrame:
    """left with the latest right row at or before it of the same key, null where none is within the tolerance.

    Both sides are united and ordered by key, slice of time and time. Only the last right row of each slice is handed
    to later slices, so a hot key is shared out by its slices.
    """
    held = F.struct(F.col(on).alias("_ts"), *values)
    a = left.select(*keys, F.col(on), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_r"))
    b = right.select(*keys, F.col(on), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_r"))
    both = a.unionByName(b).withColumn("_slice", F.window(on, slice_width).start)
    ends = both.filter("_r is not null").groupBy(*keys, "_slice").agg(F.max_by("_r", F.col("_r._ts")).alias("_end"))
    marks = both.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    marks = marks.select(*keys, "_slice", before.alias("_before"))
    w = W.partitionBy(*keys, "_slice").orderBy(F.col(on), F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).filter("_row is not null")
    met = met.join(marks, [*keys, "_slice"]).withColumn("_hit", F.coalesce("_in", "_before"))
    close = F.lit(True)
    if tolerance_ms is not None:
        close = micros(on) - micros("_hit._ts") <= tolerance_ms * 1000
    return met.select("_row.*", *[F.when(close, F.col(f"_hit.{v}")).alias(v) for v in values])


def interpolate(df: DataFrame, ts: str, value: str, keys: list[str], tie: str, slice_us: int = 86_400_000_000) -> DataFrame:
    """df with nulls of value filled linearly from the neighbours of the same key by (ts, tie), flat beyond the ends.

    Rows are ordered within key and slice of time; only the first and last known value of each slice are handed to other
    slices, so a hot key is shared out by its slices. Rows without ts come first and keep their value. The value ahead is the
    last one behind in descending order: a frame that ends at the last row would be read anew for every row. Between two
    known values at one instant there is no line: NaN.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(micros(ts).alias("t"), F.col(value).alias("v")))
    df = df.withColumns({"_slice": F.coalesce(F.floor(micros(ts) / slice_us), F.lit(-(1 << 62))), "_known": known})
    order = F.struct(F.col(ts), F.col(tie))
    held = df.filter("_known is not null")
    ends = held.groupBy(*keys, "_slice").agg(F.min_by("_known", order).alias("_first"), F.max_by("_known", order).alias("_last"))
    marks = df.select(*keys, "_slice").distinct().alias("m").join(
        ends.alias("e"), [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, "_slice"]], "left"
    ).select("m.*", "_first", "_last")
    by = lambda at: W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(
        *[F.col(k).alias(f"_m{i}") for i, k in enumerate([*keys, "_slice"])],
        F.last("_last", ignorenulls=True).over(by(F.asc("_slice"))).alias("_before"),
        F.last("_first", ignorenulls=True).over(by(F.desc("_slice"))).alias("_after"),
    )
    near = lambda *at: F.last("_known", ignorenulls=True).over(
        W.partitionBy(*keys, "_slice").orderBy(*at).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({"_p": near(F.asc(ts), F.asc(tie)), "_n": near(F.desc(ts), F.desc(tie))})
    df = df.join(marks, [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate([*keys, "_slice"])])
    df = df.withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")})
    p, n = F.col("_p"), F.col("_n")
    span = (n.t - p.t) / 1e6
    line = p.v + F.when(span == 0, F.lit(float("nan"))).otherwise((n.v - p.v) * ((micros(ts) - p.t) / 1e6) / span)
    filled = F.coalesce(F.col(value), F.when(p.isNull(), n.v).when(n.isNull(), p.v).otherwise(line))
    return df.withColumn(value, filled).drop("_slice", "_known", "_p", "_n", "_before", "_after", *[f"_m{i}" for i in range(len(keys) + 1)])


def tiers(parts: list[tuple[DataFrame, str | None, str | None]], ts: str) -> DataFrame:
    """Union of tiers, each read only in its own range [from, to)."""
    out = None
    for df, low, high in parts:
        if low is not None:
            df = df.filter(F.col(ts) >= F.lit(low).cast("timestamp"))
        if high is not None:
            df = df.filter(F.col(ts) < F.lit(high).cast("timestamp"))
        out = df if out is None else out.unionByName(df)
    return out


def as_of(df: DataFrame, keys: list[str], system: str, cutoff: Column, valid: tuple[str, str] | None = None, at: Column | None = None,
          deleted: str | None = None, skip_invalid: bool = False) -> DataFrame:
    """Version of each key at a system time: the latest not after cutoff, without tombstones, that holds at the valid time.

    skip_invalid: a version that doesn't hold at the valid time gives way to an older one (array cells), while a
    tombstone ends the search.
    """
    df = df.filter(F.col(system) <= cutoff)
    holds = F.lit(True)
    if valid and at is not None:
        holds = (F.col(valid[0]) <= at) & (F.coalesce(F.col(valid[1]) > at, F.lit(True)))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    if skip_invalid:
        df = df.filter(holds | gone)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(system)).alias("r")).select("r.*")
    return last.filter(~gone & holds)


def breaches(df: DataFrame, keys: list[str], ts: str, breach: Column, fire_after: int, recover_after: int) -> DataFrame:
    """Alert transitions with hysteresis: `state` per row, FIRING after fire_after breaches in a row, OK after recover_after clear ones."""
    w = W.partitionBy(*keys).orderBy(ts)
    flag = df.withColumn("_b", breach)
    flag = flag.withColumn("_edge", (F.coalesce(F.lag("_b").over(w) != F.col("_b"), F.lit(True))).cast("int"))
    flag = flag.withColumn("_run", F.sum("_edge").over(w))
    flag = flag.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_run").orderBy(ts)))
    mark = F.when(F.col("_b") & (F.col("_n") >= fire_after), "FIRING").when(~F.col("_b") & (F.col("_n") >= recover_after), "OK")
    flag = flag.withColumn("_m", mark)
    state = F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit("OK"))
    return flag.withColumn("state", state).drop("_b", "_edge", "_run", "_n", "_m")
