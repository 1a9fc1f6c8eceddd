from collections import Counter, defaultdict
from itertools import combinations

from sparkweave import catalog


def lines(spark, sf):
    customer = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    return [(customer[r["l_orderkey"]] * 3, r["l_partkey"] * 3 + 1, r["l_suppkey"] * 3 + 2) for r in rows]


def test_whole_tables_against_brute_force(spark, sf):
    out, both = defaultdict(set), defaultdict(set)
    for c, p, s in lines(spark, sf):
        for a, b in ((c, p), (p, s), (s, c)):
            out[a].add(b)
            both[a].add(b)
            both[b].add(a)
    got = lambda name: [tuple(r) for r in catalog.QUERIES[f"graph_whole_{name}"](spark, sf).collect()]

    three = sum(c in both[b] for a in both for b, c in combinations([x for x in both[a] if x > a], 2))
    assert got("triangles") == [(three,)]
    per = Counter(x for a in both for b, c in combinations([x for x in both[a] if x > a], 2) if c in both[b] for x in (a, b, c))
    assert {n: t for n, t, _ in got("lcc")} == {n: per[n] for n in both}

    core = {a: set(b) for a, b in both.items()}
    while weak := [a for a in core if len(core[a]) < 6]:
        for a in weak:
            for b in core.pop(a):
                core.get(b, set()).discard(a)
    assert sorted(got("k_core")) == sorted((a, b) for a in core for b in core[a])

    rank = dict.fromkeys(both, 1 / len(both))
    for _ in range(8):
        new = dict.fromkeys(both, 0.15 / len(both))
        loose = sum(rank[a] for a in both if not out[a])
        for a in both:
            new[a] += 0.85 * loose / len(both)
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    found = dict(got("pagerank"))
    assert found.keys() == rank.keys() and all(abs(found[a] - rank[a]) < 1e-8 for a in rank)

    hops, now = {3: 0}, [3]
    while now:
        now = list({b for a in now for b in out[a]} - hops.keys())
        hops.update(dict.fromkeys(now, max(hops.values()) + 1))
    assert dict(got("traverse")) == hops

    best, todo = {3: 0.0}, [3]
    while todo:
        a = todo.pop()
        for b in out[a]:
            if best[a] + (a + b) % 5 + 1 < best.get(b, 1e9):
                best[b] = best[a] + (a + b) % 5 + 1
                todo.append(b)
    assert dict(got("sssp")) == best

    root = {}
    for a in sorted(both):
        todo = [a] if a not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = a
                todo += both[x]
    assert dict(got("wcc")) == root

    label = {a: a for a in both}
    for _ in range(10):
        new = {}
        for a in both:
            votes = Counter(label[b] for b in both[a])
            new[a] = min(votes, key=lambda x: (-votes[x], x))
        label = new
    assert dict(got("label_propagation")) == label


def test_k_core_of_the_lines_against_brute_force(spark, sf):
    both = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        o, p, s = r["l_orderkey"] * 3, r["l_partkey"] * 3 + 1, r["l_suppkey"] * 3 + 2
        for a, b in ((o, p), (p, s), (o, s)):
            both[a].add(b)
            both[b].add(a)
    core = {a: set(b) for a, b in both.items()}
    while weak := [a for a in core if len(core[a]) < 6]:
        for a in weak:
            for b in core.pop(a):
                core.get(b, set()).discard(a)
    assert sorted(map(tuple, catalog.QUERIES["graph_k_core"](spark, sf).collect())) == sorted((a, b) for a in core for b in core[a])


def test_labels_of_small_components(spark, sf):
    """Customers hung on every seventh: after two rounds a star's nodes alternate between two labels of the star."""
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    both = defaultdict(set)
    for k in keys:
        for a, b in ((k, k - k % 7), (k - k % 7, k)):
            if a != b:
                both[a].add(b)
    label = {x: x for k in keys for x in (k, k - k % 7)}
    for _ in range(10):
        new = dict(label)
        for a in both:
            votes = Counter(label[b] for b in both[a])
            new[a] = min(votes, key=lambda x: (-votes[x], x))
        label = new
    assert {r["node"]: r["label"] for r in catalog.QUERIES["graph_label_propagation"](spark, sf).collect()} == label
