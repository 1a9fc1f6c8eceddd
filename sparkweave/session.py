"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(**config: str) -> SparkSession:
    builder = SparkSession.builder.appName("sparkweave")
    for k, v in {**SETTINGS, **config}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{spark.sparkContext.getCheckpointDir()}/cut_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read again: smaller than a checkpoint, and of known size to the planner."""
    path = _folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """df in two tasks per core at most: the fewer the tasks, the more of a key's rows one of them adds up before a shuffle."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def dealt(df: DataFrame, key: str, once: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
    """df written as a table in buckets of key, one file each, so that joins by key in every round leave it where it is.

    With once equal rows are kept once, without a shuffle of their own; then makes other rows of what lies together. What is read from the table must be written before the
    block ends.
    """
    spark = df.sparkSession
    path, n = _folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1]
    laid = df.repartition(n, key)
    laid = laid.distinct() if once else laid
    writer = (then(laid) if then else laid).write.bucketBy(n, key).option("compression", "zstd").option("path", path)
    writer.format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
