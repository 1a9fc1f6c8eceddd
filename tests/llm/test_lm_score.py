import re
from collections import Counter
from math import isclose, log

from sparkweave.llm import lm_score, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, good):
    """Both models by counters, with a vocabulary that holds all words."""
    toks = {d: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t in docs}
    one, two = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for d, t in toks.items():
        for which in (0, 1) if d in good else (1,):
            one[which].update(t)
            two[which].update(zip(t, t[1:]))
    size = len(one[1]) + 1
    out = {}
    for d, t in toks.items():
        loss = []
        for which in (0, 1):
            n, total = one[which], sum(one[which].values())
            single = lambda x: (n[x] + 0.5) / (total + 0.5 * size)
            p = [single(t[0])] if t else []
            p += [0.7 * two[which][a, b] / max(n[a], 1) + 0.3 * single(b) for a, b in zip(t, t[1:])]
            loss.append(-sum(map(log, p)) / len(p) if p else None)
        out[d] = (len(t), *loss)
    return out


def check(got, want):
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        n, target, background = want[r["doc_id"]]
        assert r["n_tokens"] == n
        if n:
            assert isclose(r["target_loss"], target, rel_tol=1e-9) and isclose(r["background_loss"], background, rel_tol=1e-9)
        else:
            assert r["target_loss"] is None and r["score"] is None


def test_query_against_counters(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    labels = queries.table(spark, sf, "labels")
    check(queries.op5_lm_score(spark, sf).collect(), brute(rows, {r["doc_id"] for r in labels.filter("quality = 1").collect()}))


def test_no_target_and_edges(spark):
    docs = spark.createDataFrame([(1, "a b a b c", 7), (2, "a b", 7), (2, "a b", 7), (3, None, 7)], "doc_id long, text string, shard int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = lm_score.score(docs, none).collect()
    assert len(got) == 4 and all(r["score"] in (0.0, None) for r in got)
    assert lm_score.score(docs.limit(0), none).count() == 0


def test_query_separates_labels(spark, sf):
    scores = queries.op5_lm_score(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id")
    mean = {r["quality"]: r["m"] for r in scores.groupBy("quality").agg({"score": "avg"}).toDF("quality", "m").collect()}
    assert mean[1] < mean[0]


def test_many_shards(spark, sf):
    docs = queries.table(spark, sf, "documents").filter("n_chars < 4000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10**6, "neverseen a a neverseen otherwise"), (10**6 + 1, None), (10**6 + 2, " \n"), (10**6 + 3, "word " * 200_000)]
    labels = queries.table(spark, sf, "labels")
    want = brute(rows, {r["doc_id"] for r in labels.filter("quality = 1").collect()})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(lm_score.score(df, labels, part=20_000).collect(), want)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "c d"), (None, "a b"), (None, "b a"), (2, "")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, many = (sorted((tuple(r) for r in lm_score.score(docs, labels, x).collect()), key=repr) for x in (100, 2))
    assert len(whole) == len(many) == len(rows) and whole[0][:2] == (1, 2)
    for a, b in zip(whole, many):
        assert a[:2] == b[:2] and all(x == y or isclose(x, y, abs_tol=1e-9) for x, y in zip(a[2:], b[2:]))


def test_texts_are_exchanged_once(spark, sf):
    df = queries.op5_lm_score(spark, sf)
    df.write.format("noop").mode("overwrite").save()
    held = df.collect() and df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in held
