"""Exact percentiles per group from cumulative frequencies.

The rows are reduced to counts per (group, measure, value): a mergeable partial
result, of a day or a file, whose counts add up. The counts are sorted by range
over all partitions, a window sums them up within each partition, the totals of
the partitions before are added, and the first value that reaches a target rank
is the percentile. The error is zero: the value is the one with 1-based rank
ceil(p x n) among the n non-null values of its group.

At scale: the reduction combines on the map side, so a heaped value is one row
per task. A group that holds a third of all rows spans many range partitions,
as the range is over (group, measure, value). The offsets have at most
(groups + partitions) rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import materialize


def frequencies(df: DataFrame, groups: list[str | Column], measures: list[str]) -> DataFrame:
    """Counts per group, measure (its name) and value: the group columns, measure, value, n.

    Null values of a measure are left out; a null group is a group of its own. Measures must be numbers;
    integers stay bigint where all are, else all become double (NaN counts as the largest value).
    """
    kinds = dict(df.dtypes)
    whole = all(kinds[m] in ("tinyint", "smallint", "int", "bigint") for m in measures)
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("bigint" if whole else "double").alias("value")) for m in measures])
    long = df.select(*groups, F.explode(pairs).alias("_m")).select("*", "_m.measure", "_m.value").drop("_m")
    keys = [c for c in long.columns]
    return long.where(F.col("value").isNotNull()).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def merge_frequencies(*parts: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Partial counts put together; columns in ``drop`` (such as a day) are summed over."""
    df = reduce(DataFrame.unionByName, parts).drop(*drop)
    return df.groupBy(*[F.col(f"`{k}`") for k in df.columns if k != "n"]).agg(F.sum("n").alias("n"))


def roll_up(freq: DataFrame, levels: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Partial counts summed up to several levels at once: level, the ``keys``, and the other columns of ``freq``.

    ``levels`` names the keys that each level keeps; the others are null in its rows. One shuffle serves all levels, after
    map-side sums.
    """
    rows = F.array(*[F.struct(F.lit(name).alias("level"), *[(F.col(f"`{k}`") if k in own else F.lit(None).cast(freq.schema[k].dataType)).alias(k) for k in keys]) for name, own in levels.items()])
    rest = [c for c in freq.columns if c not in keys]
    return merge_frequencies(freq.select(F.inline(rows), *[F.col(f"`{c}`") for c in rest]))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and value; columns _k (a hash of the group) and n come last. Adds the partition and the sum of n so far in it, by group."""
    from pyspark import TaskContext

    pid, last, carried = TaskContext.get().partitionId(), None, 0
    for x in batches:
        if not x.num_rows:
            continue
        k, n = x.column(x.num_columns - 2).to_numpy(), x.column(x.num_columns - 1).to_numpy()
        cum = np.cumsum(n)
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        before = np.where(starts > 0, cum[starts - 1], 0)
        before[0] = -carried if k[0] == last else 0
        cum = cum - np.repeat(before, np.diff(np.append(starts, len(k))))
        last, carried = k[-1], int(cum[-1])
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(len(k), pid, np.int32)), pa.array(cum, pa.int64())], names=[*x.schema.names, "_pid", "_cum"])


def percentiles(freq: DataFrame, permille: list[int]) -> DataFrame:
    """The percentiles of each group and measure: the group columns, measure, permille, value, n, max_rank_error.

    ``freq`` is the output of frequencies, merge_frequencies or roll_up, and is read twice: once to sample the ranges.
    ``permille`` are whole numbers from 0 to 1000; 0 gives the minimum. A group without values has no rows; an empty table
    gives none. The one shuffle of the counts is that by range; the running sums are taken within its sorted partitions.
    """
    if not permille or any(not 0 <= p <= 1000 for p in permille):
        raise ValueError("permille: whole numbers from 0 to 1000")
    keys = [c for c in freq.columns if c not in ("value", "n")]
    cols = [F.col(f"`{k}`") for k in keys]
    group = F.xxhash64(*[c.isNull() for c in cols], *cols)
    ranged = freq.repartitionByRange(*cols, F.col("value")).sortWithinPartitions(*cols, F.col("value")).select(*cols, "value", group.alias("_k"), "n")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_cum", T.LongType())])
    t = materialize(ranged.mapInArrow(_running, schema), "frequencies")
    parts = t.groupBy("_k", "_pid").agg(F.max("_cum").alias("_in"))
    before = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_k", "_pid", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"), F.sum("_in").over(Window.partitionBy("_k")).alias("_total"))
    whole = t.join(offsets, ["_k", "_pid"]).withColumn("_upto", F.col("_cum") + F.col("_offset"))
    targets = F.array(*[F.struct(F.lit(p).alias("permille"), F.greatest(F.lit(1).cast("bigint"), F.expr(f"({p}L * _total + 999L) div 1000L")).alias("rank")) for p in sorted(set(permille))])
    hits = F.filter(targets, lambda x: (x["rank"] > F.col("_upto") - F.col("n")) & (x["rank"] <= F.col("_upto")))
    out = whole.withColumn("_hit", F.explode(hits))
    return out.select(*cols, F.col("_hit.permille").alias("permille"), "value", F.col("_total").alias("n"), F.lit(0).cast("bigint").alias("max_rank_error"))
