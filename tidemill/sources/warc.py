"""Web archives: a data source named ``warc`` with one partition per file, read as a stream.

Register it with ``register(spark)``, then ``spark.read.format("warc").load(path)``; or call ``read_warc``. Paths are of the local
file system, or addresses that Arrow's file systems know (s3:// or s3a://, gs://, hdfs://), whose credentials come from the
environment of the executors.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ip string, url string, contents binary"


def records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and body of each record, of whatever type; a record that breaks off ends the file."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        body = f.read(size)
        if len(body) < size:
            return
        yield headers, body


def pages(f: BinaryIO, largest: int | None = None) -> Iterator[tuple[str | None, str | None, bytes]]:
    """ip, address and payload of each response; records of other types, and larger than ``largest`` bytes, are passed over."""
    for h, body in records(f):
        if h.get("warc-type") == "response" and (largest is None or len(body) <= largest):
            yield h.get("warc-ip-address"), h.get("warc-target-uri", "").strip("<>") or None, body


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _files(path: str) -> list[str]:
    """The files that a path stands for: itself, those below it, or those that it matches as a glob; as addresses of its scheme."""
    system, own = _system(path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    wild = next((i for i, x in enumerate(own.split("/")) if set(x) & set("*?[")), None)
    base = own if wild is None else "/".join(own.split("/")[:wild]) or "/"
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [x.path for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]
    if wild is not None:
        found = [x for x in found if x.count("/") == own.count("/") and fnmatch.fnmatchcase(x, own)]
    return sorted(scheme + x for x in found if not x.rsplit("/", 1)[-1].startswith((".", "_")))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.largest = options["path"], options.get("largest")

    def partitions(self) -> list[InputPartition]:
        return [_Part(x) for p in self.path.split(",") for x in _files(p)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _open(partition.path) as f:
            yield from pages(f, int(self.largest) if self.largest else None)


def _open(path: str) -> BinaryIO:
    system, own = _system(path)
    raw = system.open_input_stream(own, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """The pages of archive files on a file system that all machines share: a file, a glob, a directory, or several by commas."""
    register(spark)
    reader = spark.read.format("warc")
    if largest is not None:
        reader = reader.option("largest", str(largest))
    return reader.load(path)


def crawl_files(crawl_id: str, base: str = "s3://commoncrawl", listing: str = "warc.paths.gz") -> list[str]:
    """The addresses of a crawl's archive files, from the listing published with it: one path a line, below ``base``."""
    with _open(f"{base}/crawl-data/{crawl_id}/{listing}") as f:
        return [f"{base}/{line.decode().strip()}" for line in f.read().splitlines() if line.strip()]


def read_crawl(spark: SparkSession, crawl_id: str, base: str = "s3://commoncrawl", largest: int | None = None) -> DataFrame:
    """The pages of a whole crawl, by its id."""
    return read_warc(spark, ",".join(crawl_files(crawl_id, base)), largest)
