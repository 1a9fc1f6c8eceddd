"""JSON documents as text Columns: building, editing and comparing, with Spark's variant for values of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def _fields(doc: Column) -> Column:
    return F.from_json(doc, _MAP)


def json_type(doc: Column) -> Column:
    """object, array, string, boolean, null or number, by the first character; null for null."""
    first = F.substring(F.ltrim(doc), 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null").when(first.rlike("[-0-9]"), "number")
    )


def json_object(**values: Column) -> Column:
    """An object with these fields; null values stay, as null."""
    return F.to_json(F.struct(*[x.alias(k) for k, x in values.items()]), {"ignoreNullFields": "false"})


def json_array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def json_remove(doc: Column, key: str) -> Column:
    """doc without a top-level key."""
    return F.to_json(F.map_filter(_fields(doc), lambda k, _: k != key))


def json_merge(a: Column, b: Column) -> Column:
    """The top-level fields of both, those of b where both have one."""
    x, y = _fields(a), _fields(b)
    return F.to_json(F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y))


def json_set(doc: Column, key: str, value: Column) -> Column:
    """doc with a top-level key set to a value, given as JSON text."""
    return json_merge(doc, F.concat(F.lit("{" + f'"{key}":'), value, F.lit("}")))


def json_contains(doc: Column, part: Column) -> Column:
    """Whether every top-level field of part is in doc with an equal value."""
    x, y = _fields(doc), _fields(part)
    return F.forall(F.map_keys(y), lambda k: F.coalesce(F.to_json(x[k]) == F.to_json(y[k]), F.lit(False)))
