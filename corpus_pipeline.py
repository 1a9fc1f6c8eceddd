"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return
the columns of documents. run() writes each stage's rows as Parquet under the shared folder and
reads them again, so a lost executor costs a stage's tasks, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import containment, mixing, ngram_join, quality, sharding
from sparkweave.llm.recovery import drop_written, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.keep_one(docs, k=5, top=80, bottom=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target asks."""
    return mixing.mix(docs, cut_last=False)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the compacted store holds them, with their shard."""
    return sharding.shard(docs).read()


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
    ("sharding", sharded),
]

#: Hash order decides which documents the mix takes; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
