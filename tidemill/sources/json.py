"""JSON: one object a line, or objects one after another with or without line ends between them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.types import as_schema


def read_json(spark: SparkSession, paths: str | list[str], schema: Any = None, *, errors: str = "raise") -> DataFrame:
    """JSON Lines. Spark reads only the first of several objects in a line; use read_json_concatenated for those."""
    mode = {"raise": "FAILFAST", "null": "PERMISSIVE", "drop": "DROPMALFORMED"}[errors]
    reader = spark.read.option("mode", mode)
    wanted = as_schema(schema)
    if wanted is not None:
        reader = reader.schema(wanted.add("_corrupt_record", "string") if errors == "null" else wanted)
    return reader.json(paths)


def split_values(text: str, *, unique_keys: bool = True) -> Iterator[str]:
    """The JSON values of a text, one after another, each as text on one line."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if unique_keys and len(out) < len(items):
            raise ValueError(f"a key occurs twice in an object: {[k for k, _ in items]}")
        return out

    decode = json.JSONDecoder(object_pairs_hook=pairs).raw_decode
    at, end = 0, len(text)
    while True:
        while at < end and text[at] in " \t\r\n\ufeff":
            at += 1
        if at >= end:
            return
        value, at = decode(text, at)
        yield json.dumps(value, ensure_ascii=False)


def read_json_concatenated(spark: SparkSession, paths: str | list[str], schema: Any = None, *, unique_keys: bool = True) -> DataFrame:
    """All objects of each file, however they are set apart; a key that occurs twice in an object raises with ``unique_keys``.

    A file is read whole by one task. Without a schema it is inferred, by another pass.
    """
    many = [paths] if isinstance(paths, str) else list(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                out: list[str] = []
                for v in split_values(text or "", unique_keys=unique_keys):
                    out.append(v)
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = spark.read.text(many, wholetext=True).mapInArrow(run, "value string")
    wanted = as_schema(schema)
    if wanted is None:
        # the analysis of one file suffices for no schema, so all values are looked at
        return spark.read.json(lines.rdd.map(lambda r: r[0]))
    return lines.select(F.from_json("value", wanted, {"mode": "FAILFAST"}).alias("r")).select("r.*")
