"""Key-value tables: columns key, value and expires_at (null: never)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import micros


def live(df: DataFrame, now: Column) -> DataFrame:
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def ttl(df: DataFrame, now: Column) -> DataFrame:
    """(key, ttl_ms) of live keys; -1 where a key never expires."""
    left = ((micros("expires_at") - micros(now)) / 1000).cast("long")
    return live(df, now).select("key", F.coalesce(left, F.lit(-1).cast("long")).alias("ttl_ms"))


def fold(log: DataFrame, at: str) -> DataFrame:
    """State after a command log (key, op, value): SET, DEL and INCR in the order of `at`; only live keys.

    The last SET or DEL of a key and the INCRs after it are found by maxima and a conditional sum, without ordering
    a key's whole log.
    """
    base = log.filter("op <> 'INCR'").groupBy("key").agg(F.max_by(F.struct(at, "op", "value"), at).alias("b"))
    both = log.join(base, "key", "left")
    after = F.col("op").eqNullSafe("INCR") & (F.col("b").isNull() | (F.col(at) > F.col(f"b.{at}")))
    out = both.groupBy("key").agg(F.first("b").alias("b"), F.sum(F.when(after, F.col("value"))).alias("more"))
    start = F.when(F.col("b.op") == "SET", F.col("b.value"))
    value = F.when(F.col("more").isNull(), start).otherwise(F.coalesce(start, F.lit(0)) + F.col("more"))
    return out.select("key", value.alias("value")).filter("value is not null")


def board(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The first k by score with their rank; equal scores by key. Only k rows are ranked."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def rank_of(df: DataFrame, score: str, key: str, value) -> DataFrame:
    """(rank) of one key: how many stand before it, plus one."""
    own = df.filter(F.col(key) == value).select(F.col(score).alias("_s"), F.col(key).alias("_k"))
    ahead = (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(key) < F.col("_k")))
    return df.join(F.broadcast(own)).agg((F.count(F.when(ahead, 1)) + 1).alias("rank"))


def rate(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """df with `used`, the key's rows in the window of `seconds` that ends at the row, and `allowed`."""
    w = W.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    used = F.count(F.lit(1)).over(w)
    return df.withColumn("used", used).withColumn("allowed", F.col("used") <= limit)
