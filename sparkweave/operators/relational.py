"""Relational builders that plain SQL doesn't give in one clause."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def range_join(a: DataFrame, b: DataFrame, keys: list[str], at: str, low: str, high: str, width: float, parts: int = 8) -> DataFrame:
    """Pairs of rows with equal keys and low <= at <= high (at of a, low and high of b).

    Rows meet by key, by the bins of `width` that b's range touches and by one of `parts` shares of a bin of a, to which b is
    copied: few keys do not make few tasks. Both sides are dealt and merged: the planner knows b's size without its copies and
    would broadcast them through the driver, or put tasks together by what they read, which says little of what they give.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = [*keys, "_bin", "_share"]
    share = F.pmod(F.xxhash64(*a.columns), F.lit(parts))
    a = a.withColumns({"_bin": F.floor(F.col(at) / width), "_share": share})
    bins = F.when(F.col(low) <= F.col(high), F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    b = b.withColumn("_bin", F.explode(bins)).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return a.repartition(n, *met).join(b.repartition(n, *met).hint("merge"), met).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bin", "_share")


def nested_aggregate(df: DataFrame, outer: list[str], inner: list[str], **aggregates: Column) -> DataFrame:
    """Groups of groups: outer keys with `sub_groups`, an array of structs of inner keys and aggregates, by inner key."""
    per = df.groupBy(*outer, *inner).agg(*[c.alias(n) for n, c in aggregates.items()])
    return per.groupBy(*outer).agg(F.sort_array(F.collect_list(F.struct(*inner, *aggregates))).alias("sub_groups"))


def percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, percentile): F.percentile of each group, exact; nulls are left out, a group without values has null.

    Equal values are counted, the counts cut in ranges of keys and value, and only the ranges with a group's place q are
    sorted: no task holds a group.
    """
    v = F.col(value).cast("double").alias("_v")
    counts = df.select(*keys, v).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    group = W.partitionBy(*keys)
    per = ranged.groupBy(*keys, "_p").agg(F.sum("_n").alias("_s")).select(
        *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_p").alias("_range"),
        (F.sum("_s").over(group.orderBy("_p")) - F.col("_s")).alias("_before"), "_s", F.sum("_s").over(group).alias("_all"),
    ).withColumn("_at", (F.col("_all") - 1) * q)
    low, high = F.floor("_at"), F.ceil("_at")
    some = per.filter((F.col("_all") == 0) | ((F.col("_before") <= high) & (F.col("_before") + F.col("_s") > low)))
    same = F.col("_p") == F.col("_range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    start = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_p").orderBy("_v")) - F.col("_n")
    near = ranged.join(some, same).withColumn("_start", start)
    holds = lambda place: (F.col("_start") <= place) & (F.col("_start") + F.col("_n") > place)
    ends = near.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"), F.max("_at").alias("_at"))
    between = (high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high")
    return ends.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("percentile"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with exact counts; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def facets(df: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """(field, value, n, place): value counts of several fields in one pass, the first `limit` of each."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= limit)


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Callable[[Column, Column], Column]] | None = None
) -> DataFrame:
    """old with new merged by key: matched columns take merge(old, new), by default the new value; others are kept or added."""
    merge = merge or {}
    o, n = old.alias("o").withColumn("_o", F.lit(True)), new.alias("n").withColumn("_n", F.lit(True))
    both = o.join(n, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in new.columns:
            before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
            met = merge.get(c, lambda _, x: x)(before, after)
            out.append(F.when(F.col("_n").isNull(), before).when(F.col("_o").isNull(), after).otherwise(met).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return both.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate isn't true (so null keeps a row)."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate with partial maxima, not a sort of the key's rows."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(last).select("r.*")


def weighted_pick(df: DataFrame, weight: str, count: int, seed: int, key: str) -> DataFrame:
    """count rows without replacement, with chances by weight: the largest u ** (1 / weight), u a hash of seed and key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 1) / float(1 << 53)
    return df.filter(F.col(weight) > 0).orderBy((F.log(u) / F.col(weight)).desc(), key).limit(count)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with each check's outcome."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    return df.withColumns(checks).filter(~ok)


def hash_links(df: DataFrame, order: str, digest: str) -> DataFrame:
    """df with `link`, the hash of the previous row's digest and its own.

    The predecessor is found by a range-partitioned pass: rows are cut in ranges of `order`, and each range's last
    digest is handed to the next, so no task sorts the whole table.
    """
    ranged = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    ends = ranged.groupBy("_p").agg(F.max_by(digest, order).alias("_end"))
    before = ends.select(F.lead("_p").over(W.orderBy("_p")).alias("_p"), "_end")
    inner = F.lag(digest).over(W.partitionBy("_p").orderBy(order))
    out = ranged.withColumn("_prev", inner).join(F.broadcast(before), "_p", "left")
    return out.withColumn("link", F.sha2(F.concat(F.coalesce("_prev", "_end", F.lit("")), digest), 256)).drop("_p", "_prev", "_end")


def count_min(df: DataFrame, item: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(row, bucket, count): a count-min sketch of `depth` rows; its size does not depend on the data."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(item, F.lit(i)), F.lit(width)).alias("bucket")) for i in range(depth)]))
    return df.select(rows.alias("c")).groupBy("c.row", "c.bucket").agg(F.count("*").alias("count"))


def count_min_estimates(sketch: DataFrame, items: DataFrame, item: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """(item, estimate): the least counter of each item, never under its true count."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(item, F.lit(i)), F.lit(width)).alias("bucket")) for i in range(depth)]))
    asked = items.select(item, rows.alias("c")).select(item, "c.*")
    return asked.join(F.broadcast(sketch), ["row", "bucket"], "left").groupBy(item).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))
