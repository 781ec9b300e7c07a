"""Mergeable sketches: distinct counts, frequent items, counters, and samples.

Sizes follow the usual formulas from error bounds. Each has a ``build`` (a partial result per group, a binary column),
a ``merge`` of partial results and an ``estimate``; all are built-in aggregates with partial and final stages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register_bits(error_rate: float) -> int:
    """log2 of the number of registers for a relative standard error: between 4 and 16."""
    if not 0 < error_rate < 1:
        raise ValueError("error_rate must lie between 0 and 1")
    p = math.ceil(2 * math.log2(1.04 / error_rate))
    if not 4 <= p <= 16:
        raise ValueError(f"error_rate {error_rate} needs 2^{p} registers; from about 0.00407 to 0.367 is possible")
    return p


def count_min_size(probability: float, tolerance: float) -> tuple[int, int]:
    """Depth and width of a count-min sketch."""
    if not 0 < probability < 1 or not 0 < tolerance < 1:
        raise ValueError("probability and tolerance must lie between 0 and 1")
    width = 1 << max(1, math.ceil(math.log2(max(2, round(2 / tolerance)))))
    return max(1, math.floor(math.log(1 - probability) / math.log(0.5))), width


class HyperLogLog:
    """Distinct counts with a relative standard error."""

    def __init__(self, error_rate: float = 0.02) -> None:
        self.bits = register_bits(error_rate)

    def build(self, x: Column) -> Column:
        return F.hll_sketch_agg(x, self.bits)

    @staticmethod
    def merge(sketch: Column) -> Column:
        return F.hll_union_agg(sketch)

    @staticmethod
    def union(a: Column, b: Column) -> Column:
        return F.hll_union(a, b)

    @staticmethod
    def estimate(sketch: Column) -> Column:
        return F.hll_sketch_estimate(sketch)

    @classmethod
    def intersection(cls, a: Column, b: Column) -> Column:
        """An estimate of the intersection by inclusion and exclusion, at least 0."""
        return F.greatest(F.lit(0), cls.estimate(a) + cls.estimate(b) - cls.estimate(cls.union(a, b)))


class CountMin:
    """Counts that can be too high, by at most tolerance x total with the given probability."""

    def __init__(self, probability: float = 0.99, tolerance: float = 0.002, seed: int = 1) -> None:
        self.depth, self.width = count_min_size(probability, tolerance)
        self.probability, self.tolerance, self.seed = probability, tolerance, seed

    def build(self, x: Column) -> Column:
        return F.count_min_sketch(x, F.lit(float(self.tolerance)), F.lit(float(self.probability)), F.lit(self.seed))

    def table(self, df: DataFrame, x: Column) -> DataFrame:
        """The counters as rows (depth, slot, n): mergeable by sum, and joined to ask for counts without leaving the JVM."""
        slots = F.array(*[F.struct(F.lit(i).alias("depth"), self._slot(x, i).alias("slot")) for i in range(self.depth)])
        return df.where(x.isNotNull()).select(F.explode(slots).alias("s")).groupBy("s.depth", "s.slot").agg(F.count(F.lit(1)).alias("n"))

    def _slot(self, x: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed * 1_000 + i), x), F.lit(self.width)).cast("int")

    def estimate(self, counters: DataFrame, asked: DataFrame, x: str) -> DataFrame:
        """``asked`` with a column estimate: the smallest of each value's counters, 0 for null and for values never seen."""
        slots = F.array(*[F.struct(F.lit(i).alias("depth"), self._slot(F.col(x), i).alias("slot")) for i in range(self.depth)])
        each = asked.select(x).distinct().select(x, F.explode(slots).alias("s")).select(F.col(x).alias("_x"), "s.depth", "s.slot")
        found = each.join(counters, ["depth", "slot"], "left").groupBy("_x").agg(F.min(F.coalesce("n", F.lit(0))).alias("_e"))
        return asked.join(found, F.col(x).eqNullSafe(F.col("_x")), "left").select(*asked.columns, F.when(F.col(x).isNotNull(), F.col("_e")).otherwise(0).alias("estimate"))


def top_slots(n: int, tolerance: float) -> int:
    """How many items the frequent-items sketch tracks."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return max(n, min(1_000_000, max(10 * n, math.ceil(2 / tolerance))))


def frequent_items(x: Column, n: int, tolerance: float = 0.002) -> Column:
    """An aggregate: the n most frequent items with approximate counts, array<struct<item, count>>, descending."""
    return F.call_function("approx_top_k", x, F.lit(n), F.lit(top_slots(n, tolerance)))


def frequent_build(x: Column, n: int, tolerance: float = 0.002) -> Column:
    return F.call_function("approx_top_k_accumulate", x, F.lit(top_slots(n, tolerance)))


def frequent_merge(state: Column, n: int, tolerance: float = 0.002) -> Column:
    return F.call_function("approx_top_k_combine", state, F.lit(top_slots(n, tolerance)))


def frequent_estimate(state: Column, n: int) -> Column:
    return F.call_function("approx_top_k_estimate", state, F.lit(n))


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, each set of n equally likely (all rows if there are fewer), in no particular order.

    Each task keeps its n smallest random numbers, so no more than n rows a task reach the last one.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(F.rand(seed)).limit(n)


def sample_by(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each group. Within a group the random numbers are ranked per salt first, so that no group is ranked in one task."""
    r = df.withColumn("_r", F.rand(seed)).withColumn("_s", (F.col("_r") * 1_000_003 % 64).cast("int"))
    first = Window.partitionBy(*keys, "_s").orderBy("_r")
    kept = r.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_r"))).where(F.col("_n") <= n).drop("_r", "_s", "_n")
