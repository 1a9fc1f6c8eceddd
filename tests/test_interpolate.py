import datetime as dt
import math

from sparkweave import catalog
from sparkweave.operators import timeseries


def test_every_event_gets_a_row(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalog.QUERIES["ts_interpolate_linear_by_type"](spark, sf).count() == n


def test_values_cross_slices(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", 1, day(0), None), ("a", 2, day(1), 10.0), ("a", 3, day(5), None), ("a", 4, day(9), 90.0), ("a", 5, day(12), None)]
    rows += [(None, 6, day(2), 1.0), (None, 7, day(3), None), ("b", 8, day(3), None), ("a", 9, None, None)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v double")
    got = {r["id"]: r["v"] for r in timeseries.interpolate(df, "ts", "v", ["k"], "id").collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 50.0, 4: 90.0, 5: 90.0, 6: 1.0, 7: 1.0, 8: None, 9: 10.0}


def test_no_frame_runs_to_the_last_row(spark, capsys):
    """Such a frame is read anew for every row: quadratic in the rows of a slice."""
    df = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), 1.0)], "k string, id long, ts timestamp, v double")
    timeseries.interpolate(df, "ts", "v", ["k"], "id").explain()
    plan = capsys.readouterr().out.lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_between_two_values_at_one_instant_there_is_no_line(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, at, 1.0), ("a", 2, at, None), ("a", 3, at, 5.0)], "k string, id long, ts timestamp, v double")
    got = {r["id"]: r["v"] for r in timeseries.interpolate(df, "ts", "v", ["k"], "id").collect()}
    assert math.isnan(got[2]) and got[1] == 1.0 and got[3] == 5.0
