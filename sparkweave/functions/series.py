"""Time-series analytics as Column expressions over an ordered window.

`w` is a window partitioned by series and ordered by time; `rows(w, n)` is its frame of the last n samples.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _full(x: Column, w: WindowSpec, n: int, value: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(rows(w, n)) == n, value)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a time zone (then UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / 1e6


def _elapsed(ts: Column, w: WindowSpec) -> Column:
    """Seconds since the sample before: whole microseconds are subtracted, seconds since the epoch would lose digits."""
    return (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6


def delta(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def derivative(x: Column, ts: Column, w: WindowSpec) -> Column:
    """Change per second; null for the first sample and where time doesn't advance."""
    dt = _elapsed(ts, w)
    return F.when(dt > 0, delta(x, w) / dt)


def rate(x: Column, ts: Column, w: WindowSpec) -> Column:
    """Counter increase per second; after a reset the new value is the increase."""
    before = F.lag(x).over(w)
    dt = _elapsed(ts, w)
    return F.when(dt > 0, F.when(x < before, x).otherwise(x - before) / dt)


def moving_avg(x: Column, w: WindowSpec, n: int) -> Column:
    return _full(x, w, n, F.avg(x).over(rows(w, n)))


def moving_percentile(x: Column, w: WindowSpec, n: int, q: float) -> Column:
    return _full(x, w, n, F.percentile(x, q).over(rows(w, n)))


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    """0 where the window's population deviation is 0; null until n samples."""
    sd = F.stddev_pop(x).over(rows(w, n))
    return _full(x, w, n, F.when(sd == 0, F.lit(0.0)).otherwise((x - F.avg(x).over(rows(w, n))) / sd))


def bollinger(x: Column, w: WindowSpec, n: int, k: float) -> dict[str, Column]:
    mid, sd = F.avg(x).over(rows(w, n)), F.stddev_pop(x).over(rows(w, n))
    bands = {"upper": mid + k * sd, "lower": mid - k * sd, "mid": mid, "width": 2 * k * sd / mid}
    return {name: _full(x, w, n, c) for name, c in bands.items()}


def ema(values: Column, alpha: float) -> Column:
    """Array of exponential moving averages of an array of samples in time order (fold)."""
    step = lambda acc, x: F.struct(
        F.when(acc["last"].isNull(), x).otherwise(alpha * x + (1 - alpha) * acc["last"]).alias("last"),
        F.concat(acc["all"], F.array(F.when(acc["last"].isNull(), x).otherwise(alpha * x + (1 - alpha) * acc["last"]))).alias("all"),
    )
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(values, start, step, lambda acc: acc["all"])


def interpolate(x: Column, ts: Column, w: WindowSpec, method: str = "linear") -> Column:
    """Nulls filled from neighbours: linear (flat beyond the ends), prev, next or zero."""
    behind, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    prev, next_ = F.last(x, ignorenulls=True).over(behind), F.first(x, ignorenulls=True).over(ahead)
    if method == "zero":
        return F.coalesce(x, F.lit(0.0))
    if method in ("prev", "next"):
        return F.coalesce(x, prev if method == "prev" else next_)
    at = F.when(x.isNotNull(), seconds(ts))
    t0, t1 = F.last(at, ignorenulls=True).over(behind), F.first(at, ignorenulls=True).over(ahead)
    line = prev + (next_ - prev) * (seconds(ts) - t0) / (t1 - t0)
    return F.coalesce(x, F.when(prev.isNull(), next_).when(next_.isNull(), prev).otherwise(line))

