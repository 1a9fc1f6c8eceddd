"""Scalar functions whose meaning differs from Spark's built-in of the name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .series import micros

#: Milliseconds of the interval units.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}


def interval_ms(text: str | int) -> int:
    """Milliseconds of '15m', '1h 30m', '2 days'; an integer is seconds."""
    if isinstance(text, int):
        return text * 1000
    parts = re.findall(r"(\d+)\s*([a-zA-Z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-zA-Z]+)|\s", "", text):
        raise ValueError(text)
    return sum(int(n) * UNITS["ms" if u.lower() in ("ms", "millisecond", "milliseconds") else u[0].lower()] for n, u in parts)


def time_bucket_ms(ts: Column, width: str | int) -> Column:
    """Start of the bucket in milliseconds since the epoch, truncated toward zero."""
    w = interval_ms(width)
    ms = F.floor(micros(ts) / 1000)
    return ms - ms % w


def date_diff(a: Column, b: Column) -> Column:
    """a - b in fractional seconds."""
    return (micros(a) - micros(b)) / 1e6


def round_mode(x: Column, digits: int, mode: str = "HALF_EVEN") -> Column:
    """HALF_EVEN, HALF_UP, HALF_DOWN, TRUNCATE, CEILING (away from zero) or FLOOR."""
    scale = float(10**digits)
    y = x * scale
    whole = {
        "HALF_UP": F.signum(y) * F.floor(F.abs(y) + 0.5),
        "HALF_DOWN": F.signum(y) * F.ceil(F.abs(y) - 0.5),
        "TRUNCATE": F.signum(y) * F.floor(F.abs(y)),
        "CEILING": F.signum(y) * F.ceil(F.abs(y)),
        "FLOOR": F.floor(y).cast("double"),
    }
    return F.bround(x, digits) if mode == "HALF_EVEN" else whole[mode] / scale


def is_uuid(x: Column) -> Column:
    return x.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def is_ulid(x: Column) -> Column:
    return x.rlike(r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def id_type(x: Column) -> Column:
    return F.when(is_uuid(x), "uuid").when(is_ulid(x), "ulid").otherwise("unknown")


def coerced_eq(a: Column, b: Column) -> Column:
    """Equality of schemaless values given as text: equal text, equal numbers, or both null."""
    number = F.try_divide(a.try_cast("double"), F.lit(1)) == F.try_divide(b.try_cast("double"), F.lit(1))
    return a.eqNullSafe(b) | F.coalesce(number, F.lit(False))
