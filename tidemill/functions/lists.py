"""Lists as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def push(xs: Column, x: Column) -> Column:
    return F.array_append(xs, x)


def length(xs: Column) -> Column:
    """The number of elements; null for a null list."""
    return F.when(xs.isNotNull(), F.size(xs))


def is_empty(xs: Column) -> Column:
    return length(xs) == 0


def map_list(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(xs, f)


def try_map(xs: Column, f: Callable[[Column], Column]) -> Column:
    """The mapped list; null if any element maps to null though it wasn't null itself."""
    out = F.transform(xs, f)
    failed = F.exists(F.zip_with(xs, out, lambda a, b: a.isNotNull() & b.isNull()), lambda x: x)
    return F.when(~failed, out)


def extend(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)
