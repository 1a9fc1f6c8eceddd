import re

import numpy as np

from sparkweave.llm import containment, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def grams(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs, items, threshold=0.8):
    sets = {i: grams(t) for i, t in items.items()}
    out = set()
    for d, t in docs.items():
        own = grams(t)
        out |= {(d, i) for i, s in sets.items() if s and len(s & own) >= threshold * len(s) - 1e-12}
    return out


def test_edges(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    items = {1: text(40), 2: text(7), 3: "one two", 4: None, 5: "", 6: text(900)}
    docs = {
        1: text(3000) + "\n" + items[1].upper().replace(" ", ", ") + "! " + text(3000),
        2: items[2],
        3: "One, two",
        4: None,
        5: "",
        6: " ".join(items[1].split()[:33]),
        7: " ".join(items[1].split()[:20]),
        8: text(70000) + " " + items[6] + " " + items[2],
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for size in (10, 10**6):
        got = containment.search(d, i, "item_id", block_bytes=size).collect()
        assert {(r["doc_id"], r["item"]) for r in got} == brute(docs, items)
    assert containment.search(d.limit(0), i, "item_id").count() == 0
    assert containment.search(d, i.limit(0), "item_id").count() == 0
    twice = containment.search(d.union(d).withColumn("item", d.text), i, "item_id")
    assert twice.count() == 2 * len(brute(docs, items))


def test_benchmark_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, sf, "benchmark").collect()}
    got = {(r["doc_id"], r["item"]) for r in queries.op7_decontamination(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_licenses_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    items = {i: t for i, (_, t) in enumerate(licenses.TEMPLATES)}
    got = {(r["doc_id"], r["template_id"]) for r in queries.op1_license_scan(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_short_items_inside_documents(spark):
    items = [(1, "Alpha beta"), (2, "gamma"), (3, "one, two three four"), (4, "alpha beta"), (5, "beta delta")]
    docs = [(1, "x y alpha, BETA z z z alpha beta"), (2, "z z alpha z z z"), (3, "beta"), (4, "delta one two three four"), (5, "so gamma"), (6, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    i = spark.createDataFrame(items, "item_id long, text string")
    for size in (1, 10**6):
        got = sorted(tuple(r) for r in containment.search(d, i, "item_id", block_bytes=size).collect())
        assert got == [(1, 1, 1.0, 2), (1, 4, 1.0, 2), (4, 3, 1.0, 1), (5, 2, 1.0, 1)]
