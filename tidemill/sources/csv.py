"""Comma-separated rows: no header, double quotes, every row of the same width unless told otherwise."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.types import as_schema


def read_csv(spark: SparkSession, paths: str | list[str], schema: Any = None, *, header: bool = False, separator: str = ",", quote: str = '"', errors: str = "raise") -> DataFrame:
    """Rows of text files. Without a schema the types are inferred, by a pass over the data.

    A row is judged by all columns of the schema as soon as one of them is read; a bare count reads none. With errors="null"
    only the columns asked for are parsed, and judged.

    ``errors``: "raise" fails on a row that doesn't fit the schema, "null" keeps it with nulls and its text in
    ``_corrupt_record``, "drop" leaves it out.
    """
    mode = {"raise": "FAILFAST", "null": "PERMISSIVE", "drop": "DROPMALFORMED"}[errors]
    reader = spark.read.option("header", header).option("sep", separator).option("quote", quote).option("escape", quote).option("mode", mode)
    wanted = as_schema(schema)
    if wanted is None:
        reader = reader.option("inferSchema", "true")
    else:
        if errors == "null":
            wanted = wanted.add("_corrupt_record", "string")
        reader = reader.schema(wanted)
    return reader.option("columnPruning", errors == "null").csv(paths)
