"""Many small objects consolidated into few indexed archive files.

The container is a Parquet table with one row per *block*. A block holds the
original bytes of many objects one after another, and beside them its index:
for each object its id, bucket, key, offset, length and SHA-256. Column
pruning lets the index be read without the bytes; the blocks are read in
parallel, and any object is cut out of its block by offset and length.

Packing moves no bytes between machines: each task packs the objects of its
own scan partition. Equal bodies within a block are stored once and indexed
each time they occur.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import materialize

ENTRY = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("object_key", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),  # null: the object had no body
        T.StructField("sha256", T.StringType()),
    ]
)
SCHEMA = T.StructType([T.StructField("block_id", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY)), T.StructField("block", T.BinaryType())])
_ENTRY_PA = pa.struct([("object_id", pa.int64()), ("bucket", pa.string()), ("object_key", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
_SCHEMA_PA = pa.schema([("block_id", pa.string()), ("entries", pa.list_(_ENTRY_PA)), ("block", pa.binary())])


def _packer(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        entries: list[dict] = []
        seen: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{seq:06d}"]), pa.array([entries], pa.list_(_ENTRY_PA)), pa.array([b"".join(parts)], pa.binary())], schema=_SCHEMA_PA)

        for b in batches:
            for oid, bucket, key, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                entry = {"object_id": oid, "bucket": bucket, "object_key": key, "offset": None, "length": None, "sha256": None}
                if body is not None:
                    if size and size + len(body) > block_bytes:
                        yield flush()
                        seq, parts, entries, seen, size = seq + 1, [], [], {}, 0
                    digest = hashlib.sha256(body).hexdigest()
                    if digest not in seen:
                        seen[digest] = size
                        parts.append(body)
                        size += len(body)
                    entry |= {"offset": seen[digest], "length": len(body), "sha256": digest}
                entries.append(entry)
        if entries:
            yield flush()

    return pack


def pack_objects(
    objects: DataFrame,
    path: str,
    *,
    id_col: str = "object_id",
    bucket_col: str = "bucket",
    key_col: str = "object_key",
    body_col: str = "body",
    size_col: str | None = "size_bytes",
    block_bytes: int = 8 << 20,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write ``objects`` as an archive at ``path`` and return it (columns block_id, entries, block).

    ``block_bytes`` bounds a block, but for a single larger object, which is a block of its own.
    ``file_bytes`` is the size aimed at per file; files are joined without a shuffle. With ``size_col``
    None the sizes are taken from the bodies. Null bodies get an index entry without offset; empty
    bodies one of length 0. An empty table gives an archive without blocks. Columns not named are ignored.
    """
    spark = objects.sparkSession
    sizes = F.col(size_col) if size_col else F.length(F.col(body_col))
    total = objects.agg(F.coalesce(F.sum(sizes), F.lit(0)).cast("bigint").alias("n")).first()["n"]
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total // (2 * block_bytes)))
    src = objects.select(F.col(id_col).cast("bigint"), F.col(bucket_col).cast("string"), F.col(key_col).cast("string"), F.col(body_col).cast("binary"))
    if src.rdd.getNumPartitions() > files:
        src = src.coalesce(files)
    packed = src.mapInArrow(_packer(block_bytes), SCHEMA)
    # Row groups are checked at every row, as a row is a block of megabytes.
    writer = packed.write.options(**{"parquet.block.size": str(2 * block_bytes), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "compression": "zstd"})
    writer.mode("error").parquet(path)
    return open_archive(spark, path)


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def archive_index(archive: DataFrame) -> DataFrame:
    """One row per object: block_id and its entry; the blocks' bytes aren't read."""
    return archive.select("block_id", F.explode("entries").alias("e")).select("block_id", "e.*")


_CUT = "object_id bigint, bucket string, object_key string, length bigint, sha256 string, body binary"
FEW_BLOCKS = 1_000  # so many block ids are compared with each row group's smallest and largest, so that others aren't read
SOME_ENTRIES = 200_000  # so many index rows, of about 200 bytes each, are broadcast


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and its wanted entries to one row for each entry, with its bytes."""
    for b in batches:
        for entries, block in zip(b.column(1).to_pylist(), b.column(0)):
            data = memoryview(block.as_buffer()) if block.is_valid else memoryview(b"")
            for at in range(0, len(entries), 256):
                some = entries[at : at + 256]
                bodies = [None if e["length"] is None else bytes(data[e["offset"] : e["offset"] + e["length"]]) for e in some]
                names = ("object_id", "bucket", "object_key", "length", "sha256")
                yield pa.RecordBatch.from_arrays([pa.array([e[n] for e in some], _ENTRY_PA.field(n).type) for n in names] + [pa.array(bodies, pa.binary())], names=[*names, "body"])


def archive_bodies(archive: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The original bytes: object_id, bucket, object_key, length, sha256, body, intact.

    ``keys`` (bucket, object_key; null keys match null) restricts the lookup: they are looked up in the index, without a
    byte of a block being read, and only the blocks that hold one of them are read, each once and where it lies. Only for
    more than SOME_ENTRIES objects are those blocks shuffled, each once, to meet their index rows. ``intact`` says that the
    bytes have the checksum recorded for them; it is null for an object without a body.
    """
    if keys is None:
        rows = archive.select("block", "entries")
    else:
        wanted = keys.select(F.col("bucket").alias("_b"), F.col("object_key").alias("_k")).distinct()
        index = archive_index(archive)
        hits = index.join(wanted, F.col("bucket").eqNullSafe(F.col("_b")) & F.col("object_key").eqNullSafe(F.col("_k")), "left_semi")
        per_block = materialize(hits.groupBy("block_id").agg(F.collect_list(F.struct(*[f.name for f in ENTRY.fields])).alias("wanted")), "wanted")
        n, entries = per_block.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
        source = archive.select("block_id", "block")
        if n <= FEW_BLOCKS:
            source = source.where(F.col("block_id").isin([r["block_id"] for r in per_block.select("block_id").collect()]))
        rows = source.join(F.broadcast(per_block) if entries <= SOME_ENTRIES else per_block, "block_id").select("block", F.col("wanted").alias("entries"))
    return rows.mapInArrow(_cut_out, _CUT).withColumn("intact", F.sha2("body", 256) == F.col("sha256"))


def inflate(body: bytes) -> bytes:
    """The bytes behind any gzip, zlib, bzip2 or xz wrapping, several members included.

    A stream that breaks off gives what can be read of it; bytes behind the last member that aren't
    another one are dropped. Other bytes are returned as they are.
    """
    if body[:2] == b"\x1f\x8b":
        out = []
        while body[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            try:
                out.append(d.decompress(body))
                out.append(d.flush())
            except zlib.error:
                break
            if not d.eof:
                break
            body = d.unused_data.lstrip(b"\0")
        return b"".join(out)
    try:
        if body[:3] == b"BZh":
            return bz2.decompress(body)
        if body[:6] == b"\xfd7zXZ\x00":
            return lzma.decompress(body)
    except (OSError, EOFError, lzma.LZMAError):
        pass
    return body


def log_lines(data: bytes) -> list[bytes]:
    """The record lines of an access log: without comments and blank lines, whatever the line ends."""
    if data[:3] == b"\xef\xbb\xbf":
        data = data[3:]
    out = []
    for line in data.replace(b"\r", b"\n").split(b"\n"):
        head = line.lstrip()
        if head and head[:1] != b"#":
            out.append(line)
    return out


RECORD = T.StructType([T.StructField("object_id", T.LongType()), T.StructField("request_id", T.StringType()), T.StructField("line", T.StringType())])


def archive_records(archive: DataFrame, *, id_field: int = 14, with_line: bool = False) -> DataFrame:
    """Every record line of every object: object_id, request_id (field ``id_field``, from 0) and, if asked for, the line.

    A line with too few fields has a null request_id. Bodies that are null or empty, and objects that hold
    only comments, give no rows. A body stored once for several objects is read once and given to each.
    """
    fields = RECORD.fields[: 3 if with_line else 2]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entries, block in zip(b.column(0).to_pylist(), b.column(1)):
                data = memoryview(block.as_buffer()) if block.is_valid else memoryview(b"")
                oids: list[int] = []
                rids: list[str | None] = []
                lines: list[str] = []
                read: dict[tuple[int, int], list[tuple]] = {}
                for e in entries:
                    if not e["length"]:
                        continue
                    at = (e["offset"], e["length"])
                    if at not in read:
                        rows = []
                        for x in log_lines(inflate(bytes(data[at[0] : at[0] + at[1]]))):
                            cut = x.split(b"\t", id_field + 1)
                            rows.append((cut[id_field].strip().decode("utf-8", "replace") if len(cut) > id_field else None, x.decode("utf-8", "replace") if with_line else None))
                        read[at] = rows
                    for rid, x in read[at]:
                        oids.append(e["object_id"])
                        rids.append(rid)
                        if with_line:
                            lines.append(x)
                    if len(oids) >= 20_000:
                        yield batch(oids, rids, lines)
                        oids, rids, lines = [], [], []
                if oids:
                    yield batch(oids, rids, lines)

    def batch(oids: list, rids: list, lines: list) -> pa.RecordBatch:
        cols = [pa.array(oids, pa.int64()), pa.array(rids, pa.string())] + ([pa.array(lines, pa.string())] if with_line else [])
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return archive.select("entries", "block").mapInArrow(parse, T.StructType(fields))


def record_owners(archive: DataFrame) -> DataFrame:
    """One row per distinct request_id, with the smallest object_id of the objects that hold it.

    The records are counted down to one per id before the shuffle, so an id repeated in very many
    deliveries doesn't load one task.
    """
    records = archive_records(archive).where(F.col("request_id").isNotNull())
    return records.groupBy("request_id").agg(F.min("object_id").alias("object_id")).select("object_id", "request_id")


def compact_records(archive: DataFrame, path: str, *, file_bytes: int = 256 << 20) -> DataFrame:
    """Write every log record once (object_id, request_id, line) into few files of about ``file_bytes``; return them.

    Of several deliveries of a request_id the line of the smallest object_id stands (the smallest line in a tie).
    """
    spark = archive.sparkSession
    records = archive_records(archive, with_line=True).where(F.col("request_id").isNotNull())
    once = records.groupBy("request_id").agg(F.min(F.struct("object_id", "line")).alias("m")).select("m.object_id", "request_id", "m.line")
    once.write.mode("error").option("maxRecordsPerFile", max(1, file_bytes // 200)).option("compression", "zstd").parquet(path)
    return spark.read.schema(once.schema).parquet(path)


def gzip_members(*parts: bytes) -> bytes:
    """A gzip file of several members, as log deliveries have them."""
    return b"".join(gzip.compress(x) for x in parts)
