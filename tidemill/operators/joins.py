"""Joins against a collected right side: one row per left row, with the list of its matches.

Keys compare null-safe: a null key matches a null key. The right side is reduced to one row per key first. It is
broadcast only where Spark knows it to be small (``spark.sql.autoBroadcastJoinThreshold``, or at run time by AQE);
beyond that the join shuffles. ``flatten`` gives plain SQL rows instead of lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.types import as_schema


def right_side(left: DataFrame, right: DataFrame | Iterable[Any], schema: Any = None) -> DataFrame:
    """A DataFrame from the right side, which may be Python rows."""
    return right if isinstance(right, DataFrame) else left.sparkSession.createDataFrame(list(right), as_schema(schema))


def _on(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = None
    for a, b in zip(left, right, strict=True):
        one = F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
        cond = one if cond is None else cond & one
    return cond


def _nested(left: DataFrame, right: DataFrame, on: Sequence[str], right_on: Sequence[str], values: Sequence[str], into: str, order: Sequence[str], how: str) -> DataFrame:
    if into in left.columns:
        raise ValueError(f"the left side has a column {into} already")
    keys = [F.col(f"`{k}`").alias(f"_rk{i}") for i, k in enumerate(right_on)]
    item = F.struct(*[F.col(f"`{c}`").alias(c) for c in values]) if len(values) != 1 else F.col(f"`{values[0]}`")
    listed = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], F.struct(item.alias("v")).alias("_v")))
    grouped = right.groupBy(*keys).agg(F.transform(F.sort_array(listed), lambda x: x["_v"]["v"]).alias("_m"))
    joined = left.join(grouped, _on(on, [f"_rk{i}" for i in range(len(on))]), how)
    kind = grouped.schema["_m"].dataType.simpleString()
    return joined.select(*[left[f"`{c}`"] for c in left.columns], F.coalesce("_m", F.array().cast(kind)).alias(into))


def left_join(left: DataFrame, right: DataFrame | Iterable[Any], on: Sequence[str], *, right_on: Sequence[str] | None = None, values: Sequence[str] | None = None, into: str = "matches", order: Sequence[str] | None = None, schema: Any = None) -> DataFrame:
    """Every left row once, with its matches as a list, empty if there are none.

    ``values`` are the right columns in the list (all but the keys by default; of a single one the bare value);
    the list is sorted by ``order`` (by the values themselves by default).
    """
    r = right_side(left, right, schema)
    right_on = list(right_on or on)
    values = list(values or [c for c in r.columns if c not in right_on] or right_on)
    return _nested(left, r, list(on), right_on, values, into, list(order or values), "left")


def inner_join(left: DataFrame, right: DataFrame | Iterable[Any], on: Sequence[str], *, right_on: Sequence[str] | None = None, values: Sequence[str] | None = None, into: str = "matches", order: Sequence[str] | None = None, flatten: bool = False, schema: Any = None) -> DataFrame:
    """As left_join, without left rows that match nothing; with ``flatten`` one row for each pair."""
    r = right_side(left, right, schema)
    right_on = list(right_on or on)
    values = list(values or [c for c in r.columns if c not in right_on] or right_on)
    if not flatten:
        return _nested(left, r, list(on), right_on, values, into, list(order or values), "inner")
    flat = r.select(*[F.col(f"`{k}`").alias(f"_rk{i}") for i, k in enumerate(right_on)], *[F.col(f"`{c}`") for c in values])
    joined = left.join(flat, _on(on, [f"_rk{i}" for i in range(len(on))]), "inner")
    return joined.drop(*[f"_rk{i}" for i in range(len(on))])
