import random

from pyspark.sql import functions as F

from sparkweave import catalog
from sparkweave.operators import relational


def test_percentile_equals_the_aggregate(spark):
    pick = random.Random(7)
    rows = [(k, pick.choice([None, -1.5, 0.0, float(pick.randrange(40)), pick.random() * 9])) for k in ("a", "b", None) for _ in range(pick.randrange(200, 300))]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.9, 1.0):
        want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
        got = {r["k"]: r["percentile"] for r in relational.percentile(df, ["k"], "v", q).collect()}
        assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))


def test_exact_values_are_not_held_by_group(spark, sf):
    """One aggregate with a distinct count keeps a sketch per distinct value, and percentile a map of all values per group."""
    for name in ("agg_approx_within_bounds", "agg_percentile_cont"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "percentile_cont(" not in plan
