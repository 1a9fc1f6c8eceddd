from sparkweave.llm import quality, queries

from .oracle import same


def test_whole_table(spark, sf):
    same(queries.op10_quality_rules(spark, sf), quality.ORACLE, sf)


def test_edges(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "\n\n \n"),
        (4, "a b c " * 2 + "é z"),
        (5, "x\nx\nx y\n x\n"),
        (6, "the cat and dog sat of "+ " ".join(f"word{i} of" for i in range(60))),
        (6, "the cat and dog sat of "+ " ".join(f"word{i} of" for i in range(60))),
        (7, "same words here " * 50),
        (8, "%%% " * 60 + " ".join(f"the w{i}" for i in range(40))),
    ]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0] and not got[1]["kept"]
    assert got[4]["n_repeat_words"] == 6 and got[4]["n_words"] == 7 and got[4]["word_chars"] == 9
    assert got[5]["n_dup_lines"] == 1
    assert got[6]["kept"] and not got[7]["kept"] and got[7]["base_failed"]
    assert not got[8]["kept"] and got[8]["n_symbols"] == 180
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [6, 6]
    assert quality.judge(docs.limit(0)).count() == 0


def test_filter_repeats_no_measure(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality.keep(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    judged = quality.judge(docs).select("doc_id", "kept").collect()
    assert sorted(r["doc_id"] for r in quality.keep(docs).collect()) == sorted(r["doc_id"] for r in judged if r["kept"])


def test_clashing_names(spark):
    text = "the word of " + " ".join(f"the w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "b", "c")], "doc_id long, text string, words string, row string, hashes string")
    got = quality.judge(docs).first()
    assert (got["words"], got["row"], got["hashes"]) == ("a", "b", "c") and got["n_words"] == 123
    assert quality.keep(docs).collect() == docs.collect()
