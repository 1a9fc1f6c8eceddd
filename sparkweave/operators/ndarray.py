"""N-dimensional arrays as tables of cells: dimension columns and attribute columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_(cells: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Cells within inclusive ranges of dimensions; a bound of None is open."""
    for dim, (low, high) in ranges.items():
        if low is not None:
            cells = cells.filter(F.col(dim) >= low)
        if high is not None:
            cells = cells.filter(F.col(dim) <= high)
    return cells


def project(cells: DataFrame, dims: list[str], attrs: list[str]) -> DataFrame:
    return cells.select(*dims, *attrs)


def aggregate(cells: DataFrame, attr: str, reducer: str, dim: str | None = None) -> DataFrame:
    """sum, count, min, max or mean of an attribute, of all cells or by a dimension; nulls are skipped."""
    f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg}[reducer]
    return cells.groupBy(*([dim] if dim else [])).agg(f(attr).alias(reducer))


def elementwise(a: DataFrame, b: DataFrame, dims: list[str], op: str, attr: str) -> DataFrame:
    """a op b cell by cell; a cell on one side only keeps its value; x / 0 is null."""
    x, y = F.col(f"a.{attr}"), F.col(f"b.{attr}")
    value = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.when(y != 0, x / y)}[op]
    met = x.isNotNull() & y.isNotNull()
    both = a.alias("a").join(b.alias("b"), dims, "full")
    return both.select(*dims, F.when(met, value).otherwise(F.coalesce(x, y)).alias(attr))


def tile(cells: DataFrame, extents: dict[str, int]) -> DataFrame:
    """cells with tile_<dim>, the tile's place in each dimension."""
    return cells.withColumns({f"tile_{d}": F.floor(F.col(d) / e) for d, e in extents.items()})


def z_order(dims: list[str], bits: int = 16) -> Column:
    """Morton key of non-negative dimensions of up to `bits` bits."""
    parts = [
        F.shiftleft(F.shiftright(F.col(d).cast("long"), i).bitwiseAND(1), i * len(dims) + j)
        for i in range(bits) for j, d in enumerate(dims)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)
