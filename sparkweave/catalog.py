"""All registered queries of the reference's operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Decorator: add a query under name, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def register_sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is one SQL text over the tables; oracle where DuckDB spells it differently.

    Tables are named as {orders}: each becomes a parameter bound to its DataFrame, so nothing is registered in the
    session's catalog.
    """
    used = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = oracle or text.format(**{t: t for t in TABLES})


from .plans import arrays, graphs, keyvalue, promql, relational, scalars, search, series, spatial, streams  # noqa: E402, F401
