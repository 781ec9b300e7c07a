"""Writers: files of Parquet, CSV and JSON, tables of a database, and rows as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codecs that this build of Spark writes in Parquet.
CODECS = ("none", "snappy", "gzip", "lz4", "zstd")


def write_parquet(df: DataFrame, path: str, *, mode: str = "error", partition_by: Sequence[str] = (), codec: str = "zstd", row_group_bytes: int | None = None, page_bytes: int | None = None, dictionary: bool | None = None, rows_per_file: int | None = None) -> None:
    if codec not in CODECS:
        raise ValueError(f"codec {codec} isn't available; one of {', '.join(CODECS)} is")
    w = df.write.mode(mode).option("compression", codec)
    for k, v in (("parquet.block.size", row_group_bytes), ("parquet.page.size", page_bytes), ("maxRecordsPerFile", rows_per_file)):
        if v is not None:
            w = w.option(k, str(v))
    if dictionary is not None:
        w = w.option("parquet.enable.dictionary", str(dictionary).lower())
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "error", header: bool = False, codec: str | None = None) -> None:
    w = df.write.mode(mode).option("header", header).option("escape", '"')
    (w.option("compression", codec) if codec else w).csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "error", codec: str | None = None) -> None:
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.option("compression", codec) if codec else w).json(path)


def to_json(*columns: str | Column) -> Column:
    """A row's columns as JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_csv(*columns: str | Column) -> Column:
    return F.to_csv(F.struct(*columns))
