import pytest
from pyspark.sql import functions as F

from sparkweave.llm import queries, sharding

KIB = 1024


def store(spark, tmp_path, **options):
    return sharding.Store(spark, f"file://{tmp_path}/store", **options)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_and_sizes(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents").repartition(16)
    s = sharding.shard(docs, store=store(spark, tmp_path, target_bytes=200 * KIB))
    assert rows(s.read().drop("shard", "shard_version")) == rows(docs)
    sizes = s.manifest().toPandas()
    assert (sizes["bytes"] <= 300 * KIB).all()
    small = sizes[sizes["bytes"] * 2 <= 200 * KIB]
    assert len(sizes) < 48 and (small.groupby("tier").size() < 4).all()


def test_versions_are_immutable_and_commits_exclusive(spark, tmp_path):
    s = store(spark, tmp_path)
    one = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string").coalesce(1)
    assert s.append(one) == 1
    assert s.append(one.limit(0)) == 2
    before = rows(s.manifest(1))
    assert s.append(one) == 3 and rows(s.manifest(1)) == before
    with pytest.raises(sharding.Conflict):
        s._commit(s.manifest(1), 1)
    assert s.version() == 3 and s.read().count() == 6
    one.write.parquet(f"file://{tmp_path}/store/data/orphan")
    s.vacuum()
    assert s.read().count() == 6 and len(list((tmp_path / "store/data/orphan").glob("*.parquet"))) == 0


def test_empty_and_clash(spark, tmp_path):
    s = store(spark, tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty, store=s).read().count() == 0
    t = store(spark, tmp_path / "t")
    t.append(spark.createDataFrame([(1, 2)], "doc_id long, shard int"))
    with pytest.raises(ValueError):
        t.read()


def test_query_covers_all_rows(spark, sf):
    got = queries.op8_sharding(spark, sf)
    want = queries.table(spark, sf, "documents").select("doc_id")
    assert rows(got.select("doc_id")) == rows(want)
    assert got.filter(F.col("shard") == "").count() == 0


def test_versions_before_a_compaction_can_be_read_until_vacuum(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(4):
        s.append(spark.createDataFrame([(i, "text")], "doc_id long, text string").coalesce(1))
    assert s.compact() == 5
    count = lambda v: s.read(v).count()
    assert [count(v) for v in range(1, 6)] == [1, 2, 3, 4, 4]
    s.vacuum(keep_versions=2)
    assert [count(v) for v in (4, 5)] == [4, 4] and s.version() == 5
    assert len(list((tmp_path / "store/manifests").iterdir())) == len(list((tmp_path / "store/versions").glob("0*"))) == 2
    s.vacuum()
    assert count(5) == 4 and len(list((tmp_path / "store/data").rglob("*.parquet"))) == 1


def test_ties_and_very_long_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 3_000_000), (1, "x" * 3_000_000), (1, "y"), (None, None)], "doc_id long, text string")
    s = sharding.shard(docs, store=store(spark, tmp_path))
    assert rows(s.read().drop("shard", "shard_version")) == rows(docs)
    assert not list((tmp_path / "store/drafts").glob("[!.]*"))
