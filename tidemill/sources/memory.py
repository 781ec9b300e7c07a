"""Python collections as tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tidemill.types import as_schema


def parallelize(spark: SparkSession, rows: Iterable[Any], schema: Any = None) -> DataFrame:
    """A table from a list, tuple, deque, set, range, mapping (key, value), text (its characters) or any iterator.

    Bare values become a column ``value``; None alone is an empty optional: no rows. A range isn't held in memory.
    """
    wanted = as_schema(schema)
    if isinstance(rows, range) and wanted is None:
        return spark.range(rows.start, rows.stop, rows.step).withColumnRenamed("id", "value")
    if rows is None:
        rows = ()
    if isinstance(rows, Mapping):
        data: list[Any] = [(k, v) for k, v in rows.items()]
        return spark.createDataFrame(data, wanted or (["key", "value"] if data else "key string, value string"))
    data = list(rows)
    if data and dataclasses.is_dataclass(data[0]):
        wanted = wanted or as_schema(type(data[0]))
        data = [dataclasses.astuple(x) for x in data]
    bare = data and not isinstance(data[0], (tuple, list, dict, Row))
    if wanted is None:
        if not data:
            raise ValueError("an empty collection needs a schema")
        return spark.createDataFrame([(x,) for x in data], ["value"]) if bare else spark.createDataFrame(data)
    if bare and len(wanted.fields) == 1:
        data = [(x,) for x in data]
    return spark.createDataFrame(data, wanted)


def chars(spark: SparkSession, text: str) -> DataFrame:
    """The characters of a text, in order: pos, value."""
    return spark.createDataFrame(list(enumerate(text)), T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", T.StringType())]))
