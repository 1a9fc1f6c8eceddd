from collections import Counter

import corpus_pipeline

from . import test_containment, test_ngram_join


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages, steps = docs.columns, dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(columns)] == columns
        steps.append(docs.collect())
    assert list(stages) == [
        "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"
    ]
    texts = [{r["doc_id"]: r["text"] for r in rows} for rows in steps]
    components = test_ngram_join.brute(texts[0], 5, 80)
    assert set(texts[1]) == {i for i, (_, c) in components.items() if i == c}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert set(texts[2]) == set(texts[1]) - {d for d, _ in test_containment.brute(texts[1], items)}
    counts = Counter(r["doc_id"] for r in steps[3])
    assert max(counts.values()) <= 3 and all(texts[3][d] == texts[2][d] for d in counts)
    assert Counter(r["doc_id"] for r in steps[4]) == counts and all(r["shard"] for r in steps[4])


def test_repeated_and_null_ids(spark, sf):
    text = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, "en", None, 3), (None, text + " x", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_duplicates_by_five_words(spark, sf):
    words = [f"w{i}" for i in range(1000)]
    edited = [f"x{i}" if i % 48 == 20 else w for i, w in enumerate(words)]
    four, five = (test_ngram_join.brute({1: " ".join(words), 2: " ".join(edited)}, k, t) for k, t in ((4, 85), (5, 80)))
    assert four[2][1] == 2 and five[2][1] == 1
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()] == [1]
