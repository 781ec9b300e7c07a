"""Frequent values by multi-hash iceberg filtering.

A first pass counts rows in coarse buckets, exactly, under several hashes. A value
can only be frequent if its bucket reaches the threshold under every hash; at most
1 / support buckets of a hash do, so what is kept is bounded by the support alone,
not by the data. A second pass counts exactly the few values that survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(value: Column, i: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), value), F.lit(buckets).cast("bigint")).cast("int")


LISTED = 1_000  # so many heavy buckets of a hash are compared one by one; more are a broadcast table


def frequent_values(df: DataFrame, column: str, *, per_mille: float = 5, least: int = 5, hashes: int = 3, buckets: int | None = None) -> DataFrame:
    """The non-null values in at least ``per_mille`` thousandths of all rows and in ``least`` rows: value, n, n_rows, max_error.

    ``per_mille`` may be a fraction, down to a thousandth (one row in a million). Repeated rows count, and rows with a null
    count as rows. The counts are exact. Memory: hashes x buckets counters a task in the first pass (by default 32 buckets
    for each value that can be frequent, 16,384 at least), and at most 1000 / per_mille surviving buckets of each hash. Ties
    aren't cut: every value that reaches the threshold is given. An empty table gives no rows.
    """
    share = round(per_mille * 1000)  # in millionths
    if not 1 <= share <= 1_000_000:
        raise ValueError("per_mille: 0.001 to 1000")
    buckets = buckets or max(1 << 14, 1 << (32 * 1_000_000 // share - 1).bit_length())
    value = df.select(F.col(f"`{column}`").cast("string").alias("value"))
    slots = F.array(*[F.struct(F.lit(i).alias("h"), F.when(F.col("value").isNotNull(), _bucket(F.col("value"), i, buckets)).alias("b")) for i in range(hashes)])
    counts = value.select(F.explode(slots).alias("s")).groupBy("s.h", "s.b").agg(F.count(F.lit(1)).alias("n"))
    # hashes x (buckets + 1) rows at most; the total comes with them, so that the table is read once for both
    total = F.sum(F.when(F.col("h") == 0, F.col("n"))).over(_all())
    enough = lambda n, rows: (n * F.lit(1_000_000).cast("bigint") >= rows * F.lit(share).cast("bigint")) & (n >= least)
    heavy = counts.withColumn("total", total).where(F.col("b").isNotNull() & enough(F.col("n"), F.col("total")))
    kept = heavy.collect()  # at most hashes x 1000 / per_mille rows
    if not kept:
        return value.where(F.lit(False)).select("value", *[F.lit(0).cast("bigint").alias(c) for c in ("n", "n_rows", "max_error")])
    rows = kept[0]["total"]
    sure = value.where(F.col("value").isNotNull())
    for i in range(hashes):
        own = [r["b"] for r in kept if r["h"] == i]
        if len(own) <= LISTED:
            sure = sure.where(_bucket(F.col("value"), i, buckets).isin(own))
        else:
            table = df.sparkSession.createDataFrame([(b,) for b in own], "_b int")
            sure = sure.join(F.broadcast(table), _bucket(F.col("value"), i, buckets) == F.col("_b"), "left_semi")
    exact = sure.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(enough(F.col("n"), F.lit(rows))).select("value", "n", F.lit(rows).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("max_error"))


def _all():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy()
