"""Word and line splitting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and the ASCII controls tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null."""
    return F.array_remove(F.split(whole(text), f"[{SPACE}]+", -1), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(f"[^{SPACE}]+")).cast("long")


def lines(text: Column) -> Column:
    """Array of the \\n-split lines that hold at least one word."""
    return F.filter(F.split(whole(text), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
