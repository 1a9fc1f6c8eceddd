"""Line protocol text: `measurement,tag=v,... field=v,... [timestamp]`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(text: Column) -> Column:
    """Pairs of an unescaped comma list; a comma, equals sign or space after a backslash belongs to its name or value."""
    pairs = F.filter(F.split(text, r"(?<!\\),"), lambda p: p.rlike(r"(?<!\\)="))
    entries = F.transform(pairs, lambda p: F.struct(clean(F.regexp_extract(p, r"^(.*?)(?<!\\)=", 1)), clean(F.regexp_extract(p, r"(?<!\\)=(.*)$", 1))))
    return F.map_from_entries(entries)


def clean(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([,= ])", "$1")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(measurement, tags, fields, ts): maps of text; booleans as 1 and 0, integers without their i; ts from nanoseconds.

    Works on a batch or a stream of lines; blank lines and comments are left out.
    """
    line = F.trim(F.col(column))
    df = lines.filter((line != "") & ~line.startswith("#"))
    parts = F.split(line, r"(?<!\\) (?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    head = parts[0]
    number = lambda v: F.when(v.rlike("^(?i:t|true)$"), "1.0").when(v.rlike("^(?i:f|false)$"), "0.0").otherwise(
        F.regexp_replace(F.regexp_replace(v, r"^(-?\d+)i$", "$1"), '^"(.*)"$', "$1")
    )
    return df.select(
        clean(F.regexp_extract(head, r"^(.*?)(?:(?<!\\),|$)", 1)).alias("measurement"),
        _map(head).alias("tags"),
        F.transform_values(_map(parts[1]), lambda _, v: number(v)).alias("fields"),
        F.timestamp_micros(F.floor(F.get(parts, 2).cast("decimal(20,0)") / 1000).cast("long")).alias("ts"),
    )
