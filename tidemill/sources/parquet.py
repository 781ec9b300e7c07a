"""Parquet: files, lists of files (a repeated path repeats its rows), and directories."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemill.types import as_schema, strict_read

#: Not read from the codec list of this build of Spark.
UNSUPPORTED_CODECS = ("brotli", "lzo")


def read_parquet(spark: SparkSession, paths: str | list[str], schema: Any = None, *, strict: bool = True) -> DataFrame:
    """Rows of one file or several, in one schema. With ``schema`` only its columns are read; ``strict`` raises for a missing one."""
    many = [paths] if isinstance(paths, str) else list(paths)
    if schema is None:
        return spark.read.parquet(*many)
    return strict_read(spark, many, schema) if strict else spark.read.schema(as_schema(schema)).parquet(*many)


def read_parquet_directory(spark: SparkSession, path: str, schema: Any = None, *, partition_columns: bool = True, keep: Callable[[str], bool] | None = None) -> DataFrame:
    """All Parquet files below a directory. Names that begin with a dot or underscore, ``_SUCCESS`` and ``*.crc`` are skipped.

    ``partition_columns``: whether ``key=value`` directories become columns. ``keep`` is a predicate of the path; then the
    files are listed on the driver first (use a filter on partition columns where there are any: it prunes as well).
    """
    reader = spark.read if partition_columns else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*")
    if schema is not None:
        reader = reader.schema(as_schema(schema))
    if keep is None and not _stray(spark, path):
        return reader.parquet(path)
    files = [f for f in list_files(spark, path) if keep is None or keep(f)]
    if not files:
        if schema is None:
            raise ValueError("no file is left, and there is no schema to give an empty table")
        return spark.createDataFrame([], as_schema(schema))
    return (reader.option("basePath", path) if partition_columns else reader).parquet(*files)


def _stray(spark: SparkSession, path: str) -> bool:
    """Whether a directory has marker files that Spark itself would take for data."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/{*,*/*,*/*/*,*/*/*/*}_$folder$"))
    return found is not None and len(found) > 0


def hidden(name: str) -> bool:
    """Whether a directory entry is none of the data."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith((".crc", "._COPYING_", "_$folder$"))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The data files below a directory, sorted, by Hadoop's file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    out, stack = [], [root]
    while stack:
        for s in fs.listStatus(stack.pop()):
            p = s.getPath()
            if hidden(p.getName()):
                continue
            if s.isDirectory():
                stack.append(p)
            else:
                out.append(p.toString())
    return sorted(out)
