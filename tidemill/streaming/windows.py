"""Counts over event time, for tables and for streams: beyond the reference's finite sequences, in the same words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time_col: str, width: str, keys: Sequence[str] = (), aggs: Sequence[Column] = (), *, late: str | None = None) -> DataFrame:
    """Aggregates of each window of ``width``: window_start, window_end, the keys, the aggregates (a count by default).

    ``late`` is how long a stream waits for late rows. Rows with a null time are left out.
    """
    return _windows(df, F.window(F.col(time_col), width), time_col, keys, aggs, late)


def sliding(df: DataFrame, time_col: str, width: str, step: str, keys: Sequence[str] = (), aggs: Sequence[Column] = (), *, late: str | None = None) -> DataFrame:
    """As tumbling, with windows that begin every ``step``."""
    return _windows(df, F.window(F.col(time_col), width, step), time_col, keys, aggs, late)


def session(df: DataFrame, time_col: str, gap: str, keys: Sequence[str], aggs: Sequence[Column] = (), *, late: str | None = None) -> DataFrame:
    """As tumbling, with windows that end when nothing has come for ``gap``. For tables with hot keys use operators.sessions."""
    return _windows(df, F.session_window(F.col(time_col), gap), time_col, keys, aggs, late)


def _windows(df: DataFrame, window: Column, time_col: str, keys: Sequence[str], aggs: Sequence[Column], late: str | None) -> DataFrame:
    src = df.where(F.col(time_col).isNotNull())
    if late is not None:
        src = src.withWatermark(time_col, late)
    out = src.groupBy(window.alias("w"), *keys).agg(*(aggs or [F.count(F.lit(1)).alias("count")]))
    rest = [c for c in out.columns if c not in ("w", *keys)]
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *rest)


def deduplicated(df: DataFrame, keys: Sequence[str], time_col: str, late: str) -> DataFrame:
    """A stream without rows that repeat the keys of an earlier one within ``late``."""
    return df.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))
