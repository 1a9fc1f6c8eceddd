import hashlib
from collections import Counter

import numpy as np

from sparkweave.llm import queries, repeats


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha) of each text of a list."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        gone = gone[: len(d)]
        spans = int(gone[:1].sum() + ((~gone[:-1]) & gone[1:]).sum()) if len(d) else 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, docs):
    want = sorted((i, *b) for i, b in zip([i for i, _ in docs], brute([t for _, t in docs])))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want


def odd_texts():
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, page = text(260), text(1500)
    docs = [(0, None), (1, ""), (2, "a" * 150), (3, "a" * 5000), (4, "xyz" * 300), (5, text(199)), (6, page), (7, page), (7, page)]
    docs += [(i, text(int(rng.integers(0, 300))) + shared + text(int(rng.integers(0, 300)))) for i in range(10, 60)]
    docs += [(60, page[:700] + "#" + page[701:]), (61, page[:199]), (62, page[50:250]), (63, text(300) + shared[:200]), (64, shared[61:] * 2)]
    one = text(400)
    return docs + [(70, one + "\x00" + one), (71, text(200000))]


def test_odd_texts_against_brute_force(spark):
    docs = odd_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"part": 3000}, {"part": 20_000, "pieces": 0}):
        check(repeats.dedup(df, **options).collect(), docs)
    assert repeats.dedup(df.limit(0)).count() == 0


def test_merge_of_many_shards(monkeypatch):
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 900).astype(np.uint8))
    starts = rng.integers(100, 500, 60)
    anchored = [(int(600 - i), base[i : 700 + int(rng.integers(0, 100))] + bytes(rng.integers(97, 100, 30).astype(np.uint8))) for i in starts]
    noise = [(int(rng.integers(0, 8)), bytes(rng.integers(97, 100, 300).astype(np.uint8))) for _ in range(9)]
    pieces = [anchored[0], *noise, *anchored[1:]]
    seen = Counter(((i - q) % 8, p[i : i + 200]) for q, p in pieces for i in range(len(p) - 199))
    want = [[i for i in range(len(p) - 199) if seen[(i - q) % 8, p[i : i + 200]] > 1] for q, p in pieces]
    for size in (700, 5000, 1 << 15):
        monkeypatch.setattr(repeats, "SHARD_BYTES", size)
        assert [x.tolist() for x in repeats.repeated(pieces)] == want


def test_merge_without_the_anchors_bytes(monkeypatch):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 99, n).astype(np.uint8))
    whole, short, groups = [], [], []
    for g in range(6):
        anchor, before, after = letters(128), letters(72), letters(72)
        for _ in range(int(rng.integers(1, 30))):
            left = before[int(rng.integers(0, 73)) :]
            changed = bytearray(after)
            changed[int(rng.integers(0, 72))] ^= int(rng.integers(0, 2))
            right = bytes(changed)
            groups.append(g)
            whole.append((len(left), left + anchor + right))
            short.append((len(left), left + bytes(repeats.STAND_IN) + right))
    starts = [range(min(q, len(p) - 200) + 1) for q, p in whole]
    seen = Counter((g, q - i, p[i : i + 200]) for g, (q, p), at in zip(groups, whole, starts) for i in at)
    want = [[i for i in at if seen[g, q - i, p[i : i + 200]] > 1] for g, (q, p), at in zip(groups, whole, starts)]
    for size in (300, 4000, 1 << 15):
        monkeypatch.setattr(repeats, "SHARD_BYTES", size)
        assert [x.tolist() for x in repeats.repeated(short, groups)] == want


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    check(queries.op4_suffix_dedup(spark, sf).collect(), docs)


def test_kept_bytes_and_clashing_names(spark):
    docs = [(1, "é" * 60 + "x" * 300), (2, "y" * 50 + "é" * 60 + "x" * 300), (None, None), (3, "short")]
    df = spark.createDataFrame([(*r, 1, 2, "g") for r in docs], "doc_id long, text string, shard int, c int, g string")
    rows = repeats.dedup(df).collect()
    assert {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in rows} == {r["doc_id"]: r["kept_sha256"] for r in rows}
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs])))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
