"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources share the words of all by weight; no target exceeds `most` times its source.
2. Each source's documents are put in one random, repeatable order. Whole passes (epochs) take
   every document; the rest of the target is taken from the order's front, and what the last
   document leaves open is filled, in further rounds, with documents that still fit. What no
   document fits into is taken from the front of one more, cut at a word (cut_last; without it
   only whole documents are taken, and a source may miss its target by less than a document).
3. The taken copies of a source form blocks: the documents of one hash bucket in one epoch.
   Block counts are the exact quotas of the sources, numbered in a permuted order.
4. A binary tree over the output shards splits the quotas: at each node the left half's blocks are
   a multivariate-hypergeometric draw without replacement from the node's blocks. A shard walks
   its own path from the root with the seeds of the nodes on it, so all shards are drawn in
   parallel and agree; what it ends with is a disjoint run of each source's permuted blocks.
5. Each shard shuffles its documents locally.

A document is identified by (doc_id, source, size, hash of text); rows that agree in all four are
one unit and are taken together. One row per source reaches the driver: counts of blocks.

Edge cases: a null source is a source, last in order; null and empty texts have size 0 and are never
taken beyond 0 words; ties of the random order are broken by the identity; an empty table gives an
empty result; columns of the input that bear a working name do not matter, as only the four named
ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import cut
from .text import n_words, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Units in a bucket of a source, words in a block and in a shard of the mix.
BUCKET_UNITS, BLOCK_WORDS, SHARD_WORDS = 4096, 250_000, 5_000_000
#: Rounds that fill what a source still lacks with documents that fit.
FILL_ROUNDS = 4
UNIT = ("doc_id", "source", "size", "tie")


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return out


def units(docs: DataFrame, seed: int) -> DataFrame:
    """One row per identity: size in words, `rows` of it, and its place `draw` in the random order."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    one = rows.groupBy(*UNIT).agg(F.count("*").alias("rows"))
    return one.withColumns(
        {"draw": F.xxhash64(F.lit(seed), "doc_id", "tie"), "total": F.col("size") * F.col("rows")}
    )


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, units, source_size, target): a source's weighted share, the excess over `most` sizes reshared.

    Sources are capped in increasing order of most * size / weight, so the level at which the rest
    share is found by running sums over the sources, without iteration.
    """
    by = units.groupBy("source").agg(F.sum("total").alias("source_size"), F.sum("rows").alias("units"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.array(*[F.lit(float(x)) for x in weights])
    by = by.withColumn("weight", F.get(share, rank % len(weights)))
    by = by.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    by = by.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("open"))
    # the level that holds: the first in order whose source stays below its cap
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)
    level = free["level"]
    return by.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select(
        "source", "units", "source_size", "target"
    )


def _front(rows: DataFrame) -> DataFrame:
    """rows with `until`: words of the source up to and including the unit, in the random order.

    Two levels of running sums: over the buckets of a source, then within a bucket, so that no task
    holds a source.
    """
    sums = rows.groupBy("source", "bucket").agg(F.sum("total").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "bucket").orderBy("draw", "doc_id", "tie", "size")
    inner = F.sum("total").over(within.rowsBetween(W.unboundedPreceding, 0))
    run = rows.withColumn("inner", inner)
    joined = run.alias("a").join(sums.alias("b"), _same("source", "bucket"))
    return joined.select("a.*", (F.col("ahead") + F.col("inner")).alias("until")).drop("inner")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 1, cut_last: bool = True) -> DataFrame:
    """Units with source_size, target, bucket, `copies` (whole ones that the mix takes) and `part` (words of one more)."""
    found = cut(units(docs, seed))
    goal = cut(targets(found, weights, most))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    df = found.alias("a").join(F.broadcast(goal.alias("b")), _same("source")).select("a.*", "source_size", "target", "units", "epochs")
    buckets = F.ceil(F.greatest(F.col("units") / BUCKET_UNITS, F.col("source_size") / BLOCK_WORDS, F.lit(1)))
    # equal shares of the hash range, so bucket order is the order of `draw`
    spread = (F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) * buckets).cast("long")
    df = df.withColumn("bucket", spread).withColumn("extra", F.lit(0))
    df = df.withColumn("draw", F.shiftrightunsigned("draw", 11))
    df = cut(df)
    for _ in range(FILL_ROUNDS):
        df = _with_room(df)
        open_ = (F.col("extra") == 0) & (F.col("total") <= F.col("room")) & (F.col("epochs") < most) & (F.col("total") > 0)
        taken = _front(df.filter(open_)).filter("until <= room").drop("until").withColumn("extra", F.lit(1))
        rest = df.alias("a").join(taken.alias("b"), _same(*UNIT), "left_anti")
        df = cut(rest.unionByName(taken).drop("room"))
    df = df.withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int"))
    if not cut_last:
        return df.withColumn("part", F.lit(0).cast("long")).drop("extra", "epochs", "units")
    df = cut(_with_room(df))
    open_ = (F.col("extra") == 0) & (F.col("rows") == 1) & (F.col("room") > 0) & (F.col("room") < F.col("size"))
    pick = df.filter(open_ & (F.col("epochs") < most)).groupBy("source").agg(F.min(F.struct("draw", *UNIT)).alias("pick"))
    pick = pick.select("source", F.struct(*[f"pick.{x}" for x in UNIT]).alias("pick"))
    df = df.alias("a").join(F.broadcast(pick.alias("b")), _same("source"), "left").select("a.*", "pick")
    chosen = F.struct(*UNIT).eqNullSafe(F.col("pick"))
    return df.withColumn("part", F.when(chosen, F.col("room").cast("long")).otherwise(0)).drop(
        "extra", "epochs", "units", "room", "pick"
    )


def _with_room(df: DataFrame) -> DataFrame:
    """df with `room`: words that the unit's source still lacks."""
    got = df.groupBy("source").agg(F.sum(F.col("extra") * F.col("total")).alias("got"))
    room = F.round(F.col("target") - F.col("epochs") * F.col("source_size")) - F.col("got")
    return df.alias("a").join(F.broadcast(got.alias("b")), _same("source")).select("a.*", room.alias("room"))


def shard_path(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of each source's permuted blocks for one shard: its path through the splitting tree."""
    start, count, low, high = np.zeros(len(quotas), np.int64), quotas.astype(np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        size = int(count.sum())
        left = size * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(count, left, method="marginals") if size else count * 0
        if shard < middle:
            count, high = drawn, middle
        else:
            start, count, low = start + drawn, count - drawn, middle
    return start, count


def _drawn(names: list, quotas: np.ndarray, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                start, count = shard_path(quotas, shards, shard, seed)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in some], pa.string()), pa.array(start[some]),
                        pa.array((start + count)[some] - 1), pa.array(np.full(len(some), shard, np.int32)),
                    ],
                    names=["source", "low", "high", "shard"],
                )

    return run


def draw(planned: DataFrame, seed: int = 1) -> DataFrame:
    """One row per taken copy of a unit: its columns, epoch, words, shard and `place` in the shard's local shuffle."""
    spark = planned.sparkSession
    times = F.col("copies") + (F.col("part") > 0).cast("int")
    copies = planned.filter((times > 0) & (F.col("size") > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    copies = copies.withColumn("words", F.when(F.col("epoch") > F.col("copies"), F.col("part")).otherwise(F.col("size")))
    blocks = copies.groupBy("source", "epoch", "bucket").agg(F.sum(F.col("words") * F.col("rows")).alias("words"))
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "epoch", "bucket"), "epoch", "bucket")
    blocks = cut(blocks.withColumn("block", F.row_number().over(order) - 1))
    per = blocks.groupBy("source").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    per = per.orderBy(F.col("source").asc_nulls_last()).collect()
    quotas = np.array([r["n"] for r in per], np.int64)
    shards = max(1, round(sum(r["words"] for r in per) / SHARD_WORDS))
    runs = spark.range(shards).mapInArrow(
        _drawn([r["source"] for r in per], quotas, shards, seed), "source string, low long, high long, shard int"
    )
    dealt = runs.select("source", F.explode(F.sequence("low", "high")).alias("block"), "shard")
    where = blocks.alias("a").join(dealt.alias("b"), _same("source", "block")).select("a.source", "epoch", "bucket", "shard")
    out = copies.alias("a").join(where.alias("b"), _same("source", "epoch", "bucket")).select("a.*", "shard")
    return out.withColumn("place", F.xxhash64(F.lit(seed), "shard", "epoch", "draw"))


def mix(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """The mixed documents: the columns of docs, a document once for every copy, shard by shard in shuffled order.

    Texts move once, to their shard; within it, sorting by `place` is the local shuffle.
    """
    taken = draw(plan(docs, seed=seed, **options), seed).select(*UNIT, "shard", "place", "words")
    packed = docs.select(
        F.struct("*").alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    )
    joined = packed.alias("a").join(taken.alias("b"), _same(*UNIT)).select("a._row", "shard", "place", "words", "a.size")
    front = F.concat_ws(" ", F.slice(words(F.col("_row.text")), 1, F.col("words").cast("int")))
    shown = F.when(F.col("words") < F.col("size"), F.col("_row").withField("text", front)).otherwise(F.col("_row"))
    joined = joined.withColumn("_row", shown)
    return joined.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("_row.*")


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shard and place of each copy: one row per document, whether taken or not.

    places holds (shard, place, words) of the document's copies, by shard and place, as the splitting tree dealt them.
    """
    planned = cut(plan(docs, seed=seed))
    taken = draw(planned, seed).groupBy(*UNIT).agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "place", "words"))).alias("places")
    )
    all_ = planned.alias("a").join(taken.alias("b"), _same(*UNIT), "left").select(
        "a.doc_id", "a.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "places", "rows"
    )
    return all_.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("_i", "rows")
