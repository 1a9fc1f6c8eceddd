import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import scalar, series
from sparkweave.operators import graph, timeseries
from sparkweave.sources import line_protocol
from sparkweave.streaming import changes


def test_stream_view_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    view = changes.view(stream, ["event_type"], "value", "ts", "1 day", late=None)
    query = view.writeStream.format("memory").queryName("v").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = ["at", "event_type", "n", "low", "high"]
    got = sorted(map(tuple, spark.table("v").select(*key).collect()))
    assert got == sorted(map(tuple, changes.view(events, ["event_type"], "value", "ts", "1 day").select(*key).collect()))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for i, rows in enumerate([[(at(1), "a", 1.0), (at(9), "a", 1.0)], [(at(20), "a", 1.0)], [(at(1), "a", 5.0)], [(at(22), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    view = changes.view(stream, ["k"], "v", "ts", "1 hour", late="1 hour")
    changes.sink_to_table(view, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = {r["at"].hour: r["total"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[1] == 1.0 and rows[9] == 1.0


def test_line_protocol(spark):
    lines = [r'cpu,host=a\ b,zone=x usage=0.5,n=3i,ok=true,msg="p q" 1700000000000000000', "# no", "", "m f=1"]
    rows = line_protocol.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(rows) == 2 and rows[0]["tags"] == {"host": "a b", "zone": "x"} and rows[1]["ts"] is None
    assert rows[0]["fields"] == {"usage": "0.5", "n": "3", "ok": "1.0", "msg": "p q"}
    assert rows[0]["ts"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_intervals():
    assert scalar.interval_ms("1h 30m") == 5_400_000 and scalar.interval_ms(7) == 7000 and scalar.interval_ms("2 days") == 172_800_000
    with pytest.raises(ValueError):
        scalar.interval_ms("soon")


def test_graph_edges_without_answers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "src long, dst long")
    assert graph.shortest_path(edges, 3, 1, 5).count() == 0
    assert [tuple(r) for r in graph.shortest_path(edges, 1, 3, 5).orderBy("hop").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9)}
    assert graph.k_core(edges, 2).count() == 0 and graph.triangles(edges).count() == 0


def test_asof_slices_hand_on_values(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    left = spark.createDataFrame([("a", at(20)), ("a", at(1)), ("b", at(5))], "k string, ts timestamp")
    right = spark.createDataFrame([("a", at(2), 7)], "k string, ts timestamp, v int")
    rows = {(r["k"], r["ts"].day): r["v"] for r in timeseries.asof_join(left, right, "ts", ["k"], ["v"], None, "1 day").collect()}
    assert rows == {("a", 20): 7, ("a", 1): None, ("b", 5): None}


def test_ema_of_short_series(spark):
    row = spark.range(1).select(series.ema(F.array(F.lit(1.0), F.lit(3.0)), 0.5).alias("e")).first()
    assert row["e"] == [1.0, 2.0]
