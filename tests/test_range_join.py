from sparkweave.operators import relational


def test_edges_of_ranges_and_copies(spark):
    a = spark.createDataFrame([(1, i, float(i)) for i in range(-20, 21)] + [(2, 0, 0.0), (1, 99, None)], "k int, i int, at double")
    b = spark.createDataFrame([(1, 0, -7.0, 5.0), (1, 1, 5.0, 5.0), (1, 2, 6.0, 5.0), (1, 3, None, 5.0)], "k int, j int, low double, high double")
    got = sorted((r["i"], r["j"]) for r in relational.range_join(a, b, ["k"], "at", "low", "high", 2.5, 3).collect())
    assert got == sorted([(i, 0) for i in range(-7, 6)] + [(5, 1)])
