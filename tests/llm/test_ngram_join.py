import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import links, ngram_join, queries
from sparkweave.llm.shingles import shingles, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, k=4):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(texts, k=4, top=85, bottom=100):
    ids = sorted(texts)
    sets = {i: grams(texts[i], k) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i in ids:
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for x in where.values() for a in x for b in x if a < b}
    for a, b in pairs:
        if bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x0b\x0c.", max_size=40)), max_size=8), st.integers(1, 5))
def test_shingles_equal_iff_words_equal(texts, k):
    seen = {}
    for w in words(pa.array(texts, pa.string())):
        hashes, first = shingles(w, k)
        for i in range(len(w)):
            own = WORD.findall(lower(texts[w.row + i]))
            want = [tuple(own[j : j + k]) for j in range(len(own) - k + 1)] if len(own) >= k else [tuple(own)] * bool(own)
            got = hashes[first[i] : first[i + 1]].tolist()
            assert len(got) == len(want)
            for h, x in zip(got, want):
                assert seen.setdefault(h, x) == x
    assert len(set(seen.values())) == len(seen)


def test_tree_walk_against_sets():
    rng = np.random.default_rng(1)
    leader = np.unique(rng.integers(0, 400, 300).astype(np.uint64))
    members = [(i, np.unique(np.where(rng.random(len(leader)) < i / 200, rng.integers(0, 400, len(leader)).astype(np.uint64), leader))) for i in range(40)]
    want = {i for i, m in members if 100 * len(np.intersect1d(m, leader)) >= 85 * len(np.union1d(m, leader))}
    whole = [(i, len(m), m) for i, m in members]
    assert set(ngram_join.walk_tree(leader, len(leader), whole, 85, 100)) == want
    for at in (0, 100, 300):
        part = [(i, len(m), m[m < at]) for i, m in members]
        assert want <= set(ngram_join.walk_tree(leader[leader < at], len(leader), part, 85, 100))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(tuple(r) for r in links.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def check(got, texts):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts)


def test_groups_of_copies_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(300)]
    seed = rng.choice(vocabulary, 120).tolist()
    shared = rng.choice(vocabulary, 60).tolist()
    texts = {0: None, 1: "", 2: " \n", 3: "one two", 4: "One  two", 5: "one two three four", 6: "x " * 500}
    for i in range(10, 90):  # a chain of near copies: neighbours alike, ends not
        seed = list(seed)
        seed[int(rng.integers(120))] = f"n{i}"
        texts[i] = " ".join(seed)
    for i in range(100, 180):  # a passage shared by documents that are not alike
        texts[i] = " ".join([*rng.choice(vocabulary, 50).tolist(), *shared, *rng.choice(vocabulary, 30).tolist()])
    for i in range(200, 230):
        texts[i] = texts[100]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(ngram_join.components(docs).collect(), texts)


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.components(docs).collect()) == [(1, 2, 1), (1, 2, 1), (3, 0, 3)]
    assert ngram_join.components(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    check(queries.op9_ngram_join(spark, sf).collect(), texts)


def test_null_ids_bridge_and_ids_are_no_duplicates(spark):
    rng = np.random.default_rng(5)
    words_ = [f"w{i}" for i in range(200)]
    chain = [list(words_) for _ in range(3)]
    for i in (60, 61, 62, 63):
        chain[1][i] = chain[2][i] = f"x{i}"
    for i in (120, 123, 126, 129):
        chain[2][i] = f"y{i}"
    a, b, c = map(" ".join, chain)
    assert len(grams(a) & grams(b)) >= 0.85 * len(grams(a) | grams(b)) and len(grams(b) & grams(c)) >= 0.85 * len(grams(b) | grams(c))
    assert len(grams(a) & grams(c)) < 0.85 * len(grams(a) | grams(c))
    docs = spark.createDataFrame([(1, a), (None, b), (None, b), (3, c)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in ngram_join.components(docs).collect()) == [1, 1, 1, 1]
    other = " ".join(rng.choice(words_, 90))
    rows = [(1, a), (1, other), (1, a), (2, other), (None, b), (None, b), (None, ""), (None, ""), (5, ""), (6, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (1, other), (None, b), (None, ""), (None, ""), (5, ""), (6, None)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))
