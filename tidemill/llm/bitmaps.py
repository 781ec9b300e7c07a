"""Exact distinct counts from compressed bitmaps over dense identifiers.

Identifiers are numbered 0, 1, 2, ... by a dictionary. Of each group (a day, a
place, ...) the numbers are kept as bitmaps in buckets of 65,536, each stored in
the smallest of three forms: sorted 16-bit values, runs, or 8 KiB of bits.
Bitmaps of different days or files are OR-ed or AND-ed bucket by bucket, and
counting the bits gives the distinct count of any combination. The error is zero.

At scale: rows are reduced to distinct (group, identifier) before the dictionary
is joined, so that an identifier with a third of all rows is at most one row per
group; a bucket never holds more than 65,536 numbers, so no task gets more than
that for one group; a roll-up reads one container per group and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import materialize

BITS = 16
_SIZE = 1 << BITS
_ARRAY, _RUNS, _BITS = b"a", b"r", b"b"


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct values below 65,536 as the smallest of the three forms; the first byte names it."""
    v = np.asarray(values, dtype=np.int64)
    starts = np.flatnonzero(np.diff(v, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(v), _SIZE // 8):
        ends = np.append(starts[1:], len(v)) - 1
        return _RUNS + np.stack([v[starts], v[ends] - v[starts]], 1).astype("<u2").tobytes()
    if 2 * len(v) <= _SIZE // 8:
        return _ARRAY + v.astype("<u2").tobytes()
    bits = np.zeros(_SIZE, np.uint8)
    bits[v] = 1
    return _BITS + np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The sorted values of a container."""
    kind, raw = data[:1], np.frombuffer(data, "u1", offset=1)
    if kind == _ARRAY:
        return raw.view("<u2").astype(np.int64)
    if kind == _RUNS:
        pairs = raw.view("<u2").reshape(-1, 2).astype(np.int64)
        n = pairs[:, 1] + 1
        return np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def dictionary(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """A dense number for each distinct non-null value: value, id. It is written once.

    ``known`` is an earlier dictionary; its numbers stay, and new values are numbered on from there.
    """
    values = df.select(F.col(f"`{column}`").alias("value")).where(F.col("value").isNotNull()).distinct()
    start = 0
    if known is not None:
        values = values.join(known.select("value"), "value", "left_anti")
        start = known.count()
    t = materialize(values.withColumn("_m", F.monotonically_increasing_id()), "dictionary")
    # A row's mark holds its partition (upper bits) and its place there; one offset per partition makes it dense.
    pid = F.shiftright("_m", 33)
    sizes = t.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(start)).alias("_offset"))
    new = t.withColumn("_p", pid).join(F.broadcast(offsets), "_p")  # one row for each partition
    new = new.select("value", (F.col("_offset") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    return new if known is None else known.select("value", "id").unionByName(new)


def _streamed(out_schema: pa.Schema, n_keys: int, start, add, finish):  # noqa: ANN001, ANN202
    """For batches sorted by their first ``n_keys`` columns: folds each run of equal keys; give one container per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        state, key, rows = None, None, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out_schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        for b in batches:
            if not b.num_rows:
                continue
            cut = np.zeros(b.num_rows, bool)
            for i in range(n_keys):
                codes = pc.dictionary_encode(b.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                cut[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate([[0], np.flatnonzero(cut)])
            ends = np.append(starts[1:], b.num_rows)
            for s, e in zip(starts.tolist(), ends.tolist()):
                k = tuple(b.column(i)[s].as_py() for i in range(n_keys))
                if state is None or k != key:
                    if state is not None:
                        rows.append((*key, *finish(state)))
                    state, key = start(), k
                state = add(state, b.column(n_keys).slice(s, e - s))
                if len(rows) >= 512:
                    yield flush()
        if state is not None:
            rows.append((*key, *finish(state)))
        if rows:
            yield flush()

    return run


def _schemas(df: DataFrame, keys: list[str]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = T.StructType([df.schema[k] for k in keys] + [T.StructField("bucket", T.LongType()), T.StructField("card", T.LongType()), T.StructField("container", T.BinaryType())])
    return s, to_arrow_schema(s)


def bitmaps(df: DataFrame, groups: list[tuple[str, Column]], column: str, ids: DataFrame) -> DataFrame:
    """The bitmaps of each group's identifiers: the group columns, bucket, card (bits set), container.

    ``groups`` are (name, expression); a null group is a group of its own. Null identifiers aren't counted;
    values that the dictionary ``ids`` doesn't have are an error of the caller and are left out.
    """
    keys = [n for n, _ in groups]
    pairs = df.select(*[c.alias(n) for n, c in groups], F.col(f"`{column}`").alias("value")).where(F.col("value").isNotNull()).distinct()
    coded = pairs.join(ids, "value").select(*keys, F.shiftright("id", BITS).alias("bucket"), F.col("id").bitwiseAND(F.lit(_SIZE - 1)).cast("int").alias("low"))
    placed = coded.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket", "low")
    spark_schema, arrow_schema = _schemas(coded, keys)

    def finish(parts: list[np.ndarray]) -> tuple[int, bytes]:
        v = np.concatenate(parts)
        return len(v), pack(v)

    fold = _streamed(arrow_schema, len(keys) + 1, list, lambda s, x: s + [x.to_numpy(zero_copy_only=False)], finish)
    return placed.mapInArrow(fold, spark_schema)


def union(bm: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps OR-ed over all columns but ``keys``; also puts partial results together."""
    src = bm.select(*keys, "bucket", "container")
    placed = (src.repartition(*keys, "bucket") if keys else src.repartition("bucket")).sortWithinPartitions(*keys, "bucket")
    spark_schema, arrow_schema = _schemas(bm, keys)

    def add(bits: np.ndarray, containers: pa.Array) -> np.ndarray:
        for c in containers:
            bits[unpack(c.as_py())] = True
        return bits

    def finish(bits: np.ndarray) -> tuple[int, bytes]:
        v = np.flatnonzero(bits)
        return len(v), pack(v)

    return placed.mapInArrow(_streamed(arrow_schema, len(keys) + 1, lambda: np.zeros(_SIZE, bool), add, finish), spark_schema)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps AND-ed: for equal ``keys`` (null equals null) and bucket, the bits set in both. Empty results are left out."""
    left = a.select(*keys, "bucket", "container")
    right = b.select(*[F.col(f"`{k}`").alias(f"_r{i}") for i, k in enumerate(keys)], F.col("bucket").alias("_rb"), F.col("container").alias("_rc"))
    on = F.col("bucket") == F.col("_rb")
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}"))
    both = left.join(right, on).select(*keys, "bucket", "container", "_rc")
    spark_schema, arrow_schema = _schemas(a, keys)
    n = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hits = [np.intersect1d(unpack(p.as_py()), unpack(q.as_py()), assume_unique=True) for p, q in zip(x.column(n), x.column(n + 1))]
            keep = pa.array([len(h) > 0 for h in hits], pa.bool_())
            cols = [x.column(i).filter(keep) for i in range(n)]
            hits = [h for h in hits if len(h)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(h) for h in hits], pa.int64()), pa.array([pack(h) for h in hits], pa.binary())], schema=arrow_schema)

    return both.mapInArrow(run, spark_schema)


def count_bits(bm: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct count of each group: the keys, n_distinct, max_error (0)."""
    g = bm.groupBy(*keys) if keys else bm.groupBy()
    return g.agg(F.coalesce(F.sum("card"), F.lit(0)).cast("bigint").alias("n_distinct")).withColumn("max_error", F.lit(0).cast("bigint"))
