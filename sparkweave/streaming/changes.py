"""Change streams, incremental views and late data on Structured Streaming; each part works on a batch as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change events from one state to the next: op, keys, and `changed`, the columns whose values differ."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("old_value"))
    n = new.select(*keys, F.struct(*values).alias("new_value"))
    both = o.join(n, keys, "full")
    op = F.when(F.col("old_value").isNull(), "INSERT").when(F.col("new_value").isNull(), "DELETE").otherwise("UPDATE")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"old_value.{c}").eqNullSafe(F.col(f"new_value.{c}")), c) for c in values]))
    out = both.withColumns({"op": op, "changed": F.when(op == "UPDATE", moved)})
    return out.filter((F.col("op") != "UPDATE") | (F.size("changed") > 0))


def compacted(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest event of each key; keys whose latest is a DELETE are gone."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), order).alias("r"))
    return last.select("r.*").filter("op <> 'DELETE'")


def view(events: DataFrame, group: list[str], value: str, ts: str, width: str, late: str | None = "10 minutes") -> DataFrame:
    """Incremental aggregates by window and group. late: how late an event may be (dropped beyond); None allows all."""
    df = events.withWatermark(ts, late) if events.isStreaming and late else events
    return df.groupBy(F.window(ts, width).alias("w"), *group).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")
    ).select(F.col("w.start").alias("at"), *group, "n", "total", "low", "high", "mean")


def sink_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream to Parquet, each row once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)


def latest_into(stream: DataFrame, table: str, checkpoint: str):
    """Keep a complete, updating view in a table that is rewritten each batch (RECOMPUTE of late data)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").saveAsTable(table)

    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
