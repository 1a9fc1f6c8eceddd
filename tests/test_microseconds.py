import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweave.functions import series
from sparkweave.operators import timeseries

AT = dt.datetime(2024, 1, 17, 13, 14, 15, 172425)


def test_rates_keep_microseconds(spark):
    rows = [(1, AT, 0.0), (2, AT + dt.timedelta(microseconds=3), 1000.0)]
    df, w = spark.createDataFrame(rows, "id long, ts timestamp, v double"), W.orderBy("id")
    got = df.select("id", series.rate(F.col("v"), F.col("ts"), w).alias("r"), series.derivative(F.col("v"), F.col("ts"), w).alias("d")).collect()[1]
    assert got["r"] == got["d"] == 1000.0 / (3 / 1e6)


def test_lines_keep_microseconds(spark):
    rows = [("a", i, AT + dt.timedelta(microseconds=us), v) for i, us, v in ((1, 0, 0.0), (2, 1, None), (3, 3, 3e6))]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v double")
    got = {r["id"]: r["v"] for r in timeseries.interpolate(df, "ts", "v", ["k"], "id").collect()}
    assert got[2] == 3e6 * (1 / 1e6) / (3 / 1e6)
