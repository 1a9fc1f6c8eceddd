import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkweave.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [n for n in names if n not in fixed]
        out = fixed | {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if out[n] > most * sizes[n] + 1e-9]
        if not over:
            return out
        fixed |= {n: most * sizes[n] for n in over}


def check(rows, docs):
    sizes, totals = {}, defaultdict(int)
    for d, (source, text) in docs.items():
        sizes[d] = len(WORD.findall(text or ""))
        totals[source] += sizes[d]
    goal, taken = wanted(totals), defaultdict(int)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r["doc_id"]][0]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[source]
        assert abs(r["target"] - goal[source]) <= 1e-6 * max(1, goal[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source in totals:
        assert abs(taken[source] - goal[source]) <= 1, source


def test_whole_table_and_rerun(spark, sf):
    docs = {r["doc_id"]: (r["source"], r["text"]) for r in queries.table(spark, sf, "documents").collect()}
    first = sorted(queries.op2_mix_sources(spark, sf).collect())
    check(first, docs)
    again = queries.table(spark, sf, "documents").repartition(5, "lang")
    assert sorted(mixing.digest(again).collect()) == first


def test_edges(spark):
    rng = np.random.default_rng(5)
    docs = {i: ("hot" if i % 3 else f"s{i % 7}", "w " * int(rng.integers(1, 60))) for i in range(2000)}
    docs |= {5000: (None, None), 5001: (None, "a b"), 5002: ("empty", ""), 5003: ("\U0001f600", "x y z"), 5004: ("￿", "x")}
    rows = [(i, s, t, 1) for i, (s, t) in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    check(mixing.digest(df).collect(), docs)
    assert mixing.digest(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    size = F.regexp_count("text", F.lit(r"\S+"))
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(size).alias("n")).collect()}
    want = {r["doc_id"]: r["taken"] for r in mixing.digest(df).collect() if r["taken"]}
    assert got == want
    whole = mixing.mix(df, cut_last=False)
    assert whole.join(df, ["doc_id", "text"], "left_anti").count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y")] * 3 + [(2, "b", "x")], "doc_id long, source string, text string")
    rows = mixing.digest(df).collect()
    assert len(rows) == 4 and len({tuple(r) for r in rows if r["doc_id"] == 1}) == 1


def test_splitting_tree_is_a_partition():
    quotas = np.array([100, 0, 7, 31])
    for shards in (1, 2, 5, 16):
        runs = [mixing.shard_path(quotas, shards, i, 9) for i in range(shards)]
        for s in range(len(quotas)):
            seen = sorted(x for start, count in runs for x in range(start[s], start[s] + count[s]))
            assert seen == list(range(quotas[s]))
        sizes = [int(c.sum()) for _, c in runs]
        assert max(sizes) - min(sizes) <= 1 + shards.bit_length()


def test_places_are_those_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    monkeypatch.setattr(mixing, "BUCKET_UNITS", 16)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i % 50 + 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    planned = mixing.plan(df)
    got = mixing.draw(planned).select("source", "epoch", "bucket", "shard").distinct().collect()
    assert len({(r["source"], r["epoch"], r["bucket"]) for r in got}) == len(got)  # a block lies in one shard
    names = sorted({r["source"] for r in got})
    quotas = np.array([sum(r["source"] == n for r in got) for n in names])
    shards = max(r["shard"] for r in got) + 1
    assert shards > 8
    for shard in range(shards):
        _, count = mixing.shard_path(quotas, shards, shard, 1)
        assert [sum(r["source"] == n and r["shard"] == shard for r in got) for n in names] == count.tolist()
    places = [(p["shard"], p["place"]) for r in mixing.digest(df).collect() for p in r["places"] or ()]
    assert len(places) == len(set(places)) and {s for s, _ in places} == set(range(shards))
