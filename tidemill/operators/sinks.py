"""Terminal operators.

A sink says what to compute from a table. Where it is an aggregate it gives Columns, so that any number of sinks are
fused into one aggregation with partial and final stages, for the whole table or per group. Sinks that are no single
aggregate (sorted counts, top lists, samples, opaque folds) give a table of their own, also per group.

``keep`` is the condition of the filters before the sink. It goes into the aggregate, so a group whose rows are all
filtered out still appears.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import sketches
from tidemill.operators.grouped import STATE, grouped_fold, load, unpickled


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: the column of a group's result
RESULT = "_result"


def _kept(x: Column, keep: Column | None) -> Column:
    return x if keep is None else F.when(keep, x)


class Sink:
    """Base: ``columns`` if it is an aggregate, else ``table``."""

    fused = True

    @property
    def single(self) -> bool:
        """Whether the sink's table has one row for each group."""
        return self.fused

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        raise NotImplementedError

    def finish(self, values: dict[str, Any]) -> Any:
        return next(iter(values.values()))

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        cols = [c.alias(k) for k, c in self.columns().items()]
        return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)

    def run(self, df: DataFrame) -> Any:
        return self.finish(self.table(df).first().asDict())

    def orders(self) -> list[Column]:
        """How the rows of a group come in its list; for sinks that aren't fused."""
        return []

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row for each group: the keys and its result, as a struct or an array, in the column RESULT."""
        if self.fused:
            return df.groupBy(*keys).agg(F.struct(*[c.alias(k) for k, c in self.columns().items()]).alias(RESULT))
        rows = self.table(df, keys)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(self.orders() or [F.lit(1)])))
        own = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys])
        listed = rows.select(*keys, F.struct(rank.alias("_r"), own.alias("_v")).alias("_x")).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_x"))
        return listed.select(*keys, F.transform("_x", lambda x: x["_v"]).alias(RESULT))

    def value(self, result: Any) -> Any:
        """What the sink gives for a group, from RESULT; None stands for a group without rows."""
        if self.fused:
            return self.finish(result.asDict())
        return [tuple(r) if len(r) > 1 else r[0] for r in result or []]


@dataclass
class Count(Sink):
    """Rows; 0 for none."""

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"count": F.count(_kept(F.lit(1), keep))}


@dataclass
class Sum(Sink):
    """The sum of the non-null values; 0 for none. Overflow of whole numbers raises under ANSI rules."""

    x: str | Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"sum": F.coalesce(F.sum(_kept(col(self.x), keep)), F.lit(0))}


@dataclass
class Mean(Sink):
    """The mean of the non-null values; null for none. Empty partitions don't matter."""

    x: str | Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"mean": F.avg(_kept(col(self.x), keep))}


@dataclass
class StdDev(Sink):
    """The population standard deviation of the non-null values; 0.0 for one, null for none."""

    x: str | Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"stddev": F.stddev_pop(_kept(col(self.x), keep))}


@dataclass
class Max(Sink):
    """The largest value, NaN above all numbers; null for none."""

    x: str | Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"max": F.max(_kept(col(self.x), keep))}


@dataclass
class Min(Sink):
    """The smallest value; null for none. ``nulls_first``: null as soon as one value is null."""

    x: str | Column
    nulls_first: bool = False

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        x = col(self.x)
        low = F.min(_kept(x, keep))
        if self.nulls_first:
            low = F.when(F.count(_kept(F.when(x.isNull(), 1), keep)) == 0, low)
        return {"min": low}


@dataclass
class MaxBy(Sink):
    """The value whose key is largest; of equal keys the one with the largest ``tiebreak``. Rows with a null key are ignored."""

    x: str | Column
    key: str | Column
    tiebreak: Sequence[str | Column] = ()

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        key = col(self.key)
        order = F.struct(key.alias("k"), *[col(t).alias(f"t{i}") for i, t in enumerate(self.tiebreak)])
        return {"max_by": F.max_by(col(self.x), F.when(key.isNotNull() if keep is None else key.isNotNull() & keep, order))}


@dataclass
class MinBy(Sink):
    """The value whose key is smallest; of equal keys the one with the smallest ``tiebreak``. Rows with a null key are ignored."""

    x: str | Column
    key: str | Column
    tiebreak: Sequence[str | Column] = ()

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        key = col(self.key)
        order = F.struct(key.alias("k"), *[col(t).alias(f"t{i}") for i, t in enumerate(self.tiebreak)])
        return {"min_by": F.min_by(col(self.x), F.when(key.isNotNull() if keep is None else key.isNotNull() & keep, order))}


@dataclass
class All(Sink):
    """Whether the predicate holds for every row (a null predicate is ignored); true for none."""

    predicate: Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"all": F.coalesce(F.bool_and(_kept(self.predicate, keep)), F.lit(True))}

    def run(self, df: DataFrame) -> bool:
        return df.where(~self.predicate).isEmpty()  # stops at the first row that fails


@dataclass
class Any_(Sink):
    """Whether the predicate holds for some row; false for none."""

    predicate: Column

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"any": F.coalesce(F.bool_or(_kept(self.predicate, keep)), F.lit(False))}

    def run(self, df: DataFrame) -> bool:
        return not df.where(self.predicate).isEmpty()


@dataclass
class MostFrequent(Sink):
    """The n most frequent values with their counts, descending: approximate in bounded memory, or exact.

    ``probability`` has no part in Spark's sketch, which bounds the error for certain.
    """

    x: str | Column
    n: int
    probability: float = 0.99
    tolerance: float = 0.002
    exact: bool = False

    def __post_init__(self) -> None:
        self.fused = not self.exact
        sketches.count_min_size(self.probability, self.tolerance)

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"most_frequent": sketches.frequent_items(_kept(col(self.x), keep), self.n, self.tolerance)}

    def finish(self, values: dict[str, Any]) -> list[tuple[Any, int]]:
        return [(r["item"], r["count"]) for r in values["most_frequent"] or [] if r["item"] is not None]

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        if not self.exact:
            return super().table(df, keys)
        counts = df.groupBy(*keys, col(self.x).alias("item")).agg(F.count(F.lit(1)).alias("count")).where(F.col("item").isNotNull())
        return _top(counts, keys, self.n, self.orders())

    def orders(self) -> list[Column]:
        return [F.desc("count"), F.asc("item")]

    def run(self, df: DataFrame) -> list[tuple[Any, int]]:
        if not self.exact:
            return super().run(df)
        return [(r["item"], r["count"]) for r in self.table(df).collect()]


@dataclass
class MostDistinct(Sink):
    """The n keys with the most distinct values, descending: approximate with a relative error, or exact."""

    key: str | Column
    x: str | Column
    n: int
    probability: float = 0.99
    tolerance: float = 0.002
    error_rate: float = 0.02
    exact: bool = False
    fused = False

    def __post_init__(self) -> None:
        sketches.register_bits(self.error_rate)

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        x = col(self.x)
        n = F.count_distinct(x) if self.exact else F.approx_count_distinct(x, self.error_rate)
        counts = df.groupBy(*keys, col(self.key).alias("item")).agg(n.alias("count"))
        return _top(counts, keys, self.n, self.orders())

    def orders(self) -> list[Column]:
        return [F.desc("count"), F.asc("item")]

    def run(self, df: DataFrame) -> list[tuple[Any, int]]:
        return [(r["item"], r["count"]) for r in self.table(df).collect()]


def _top(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


@dataclass
class Histogram(Sink):
    """Every distinct value with its count, ascending; null comes last."""

    x: str | Column
    fused = False

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return df.groupBy(*keys, col(self.x).alias("value")).agg(F.count(F.lit(1)).alias("count"))

    def orders(self) -> list[Column]:
        return [F.asc_nulls_last("value")]

    def run(self, df: DataFrame) -> list[tuple[Any, int]]:
        return [(r["value"], r["count"]) for r in self.table(df).orderBy(F.asc_nulls_last("value")).collect()]


@dataclass
class SortN(Sink):
    """The first n rows by ``order``, ascending unless a Column says otherwise; nulls last. Give a total order for a certain result."""

    n: int
    order: Sequence[str | Column]
    fused = False

    def orders(self) -> list[Column]:
        return [F.asc_nulls_last(o) if isinstance(o, str) else o for o in self.order]

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        if self.n < 0:
            raise ValueError("n must not be negative")
        return _top(df, keys, self.n, self.orders())

    def run(self, df: DataFrame) -> list[Any]:
        return self.table(df).orderBy(*self.orders()).collect()


@dataclass
class Sample(Sink):
    """n rows drawn without replacement, each set equally likely; all rows if there are fewer."""

    n: int
    seed: int = 0
    fused = False

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return sketches.sample_by(df, keys, self.n, self.seed) if keys else sketches.sample(df, self.n, self.seed)

    def run(self, df: DataFrame) -> list[Any]:
        return self.table(df).collect()


@dataclass
class Fold(Sink):
    """An opaque fold: ``step(state, row)`` within a partition, ``merge(state, state)`` between them, ``zero()`` at every level.

    Merging goes up a tree, so the driver sees few states; per group, states are shuffled by group. Runs in Python, row by
    row: use an aggregate where there is one. As a table (per group) the states are of the type ``schema``.
    """

    zero: Callable[[], Any]
    step: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    depth: int = 2
    schema: str | None = None
    fused = False

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return grouped_fold(df, keys, self.zero, self.step, self.merge).withColumnRenamed(STATE, RESULT)

    def value(self, result: Any) -> Any:
        return self.zero() if result is None else load(bytes(result))

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        if not keys or self.schema is None:
            raise ValueError("a fold is a table per group, and with a schema for its states")
        return unpickled(grouped_fold(df, keys, self.zero, self.step, self.merge), "fold", self.schema)

    def run(self, df: DataFrame) -> Any:
        zero, step, merge = self.zero, self.step, self.merge

        def part(rows: Any) -> Any:
            state = zero()
            for r in rows:
                state = step(state, r)
            yield state

        states = df.rdd.mapPartitions(part)
        if not states.getNumPartitions():
            return zero()
        return states.treeReduce(merge, self.depth)


_BUILT_IN = {"sum": F.sum, "max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or, "product": F.product, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}


@dataclass
class Combine(Sink):
    """An associative and commutative reduction of non-null values; None for none. A name of a built-in one stays in the JVM."""

    x: str | Column
    f: str | Callable[[Any, Any], Any]
    depth: int = 2

    def __post_init__(self) -> None:
        self.fused = isinstance(self.f, str)

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return {"combine": _BUILT_IN[self.f](_kept(col(self.x), keep))}

    def _fold(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        f = self.f

        def merge(a: Any, b: Any) -> Any:
            return b if a is None else a if b is None else f(a, b)

        named = df.select(*keys, col(self.x).alias("_x"))
        return grouped_fold(named, keys, lambda: None, lambda s, r: merge(s, r["_x"]), merge)

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return super().grouped(df, keys) if self.fused else self._fold(df, keys).withColumnRenamed(STATE, RESULT)

    def value(self, result: Any) -> Any:
        return super().value(result) if self.fused else None if result is None else load(bytes(result))

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        if self.fused:
            return super().table(df, keys)
        kind = df.select(col(self.x)).schema.fields[0].dataType.simpleString()
        return unpickled(self._fold(df, keys), "combine", kind)

    def run(self, df: DataFrame) -> Any:
        if self.fused:
            return super().run(df)
        f = self.f

        def part(rows: Any) -> Any:
            state = None
            for r in rows:
                state = r[0] if state is None else f(state, r[0])
            return iter(() if state is None else (state,))

        values = df.select(col(self.x)).dropna().rdd.mapPartitions(part)
        return None if values.isEmpty() else values.treeReduce(f, self.depth)


@dataclass
class Collect(Sink):
    """All rows, as: list, set (distinct), sorted (distinct and ordered), map (first column to second; a later row wins by ``order``),
    text (joined), arrow, pandas. What comes to the driver grows with the data; the tables of the other sinks don't."""

    into: str = "list"
    order: Sequence[str | Column] = ()
    separator: str = ""
    fused = False

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        value = [c for c in df.columns if c not in keys]
        one = F.col(f"`{value[0]}`") if len(value) == 1 else F.struct(*[F.col(f"`{c}`") for c in value])
        agg = {"list": F.sort_array(F.collect_list(one)), "set": F.sort_array(F.collect_set(one)), "sorted": F.sort_array(F.collect_set(one))}
        if self.into == "map":
            last = df.groupBy(*keys, F.col(f"`{value[0]}`").alias("k")).agg(F.max_by(F.col(f"`{value[1]}`"), F.struct(*[col(o) for o in self.order] or [F.col(f"`{value[1]}`")])).alias("v"))
            return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("map"))
        if self.into == "text":
            agg["text"] = F.array_join(F.sort_array(F.collect_list(one)), self.separator)
        return df.groupBy(*keys).agg(agg[self.into].alias(self.into))

    def run(self, df: DataFrame) -> Any:
        ordered = df.orderBy(*self.order) if self.order else df
        if self.into == "arrow":
            return ordered.toArrow()
        if self.into == "pandas":
            return ordered.toPandas()
        if self.into == "sorted":
            return df.distinct().orderBy(*[F.asc_nulls_last(c) for c in df.columns]).collect()
        rows = (df.distinct() if self.into == "set" else ordered).collect()
        bare = [r[0] for r in rows] if len(df.columns) == 1 else rows
        if self.into == "set":
            return set(bare)
        if self.into == "map":
            return {r[0]: r[1] for r in rows}
        if self.into == "text":
            return self.separator.join("" if x is None else str(x) for x in bare)
        return bare


@dataclass
class ForEach(Sink):
    """Calls a function with each row, where the row is; gives nothing back."""

    f: Callable[[Any], None]
    fused = False

    def run(self, df: DataFrame) -> None:
        df.foreach(self.f)

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        f = self.f
        return grouped_fold(df, keys, lambda: None, lambda _, r: f(r), lambda a, _: a).withColumnRenamed(STATE, RESULT)

    def value(self, result: Any) -> None:
        return None


@dataclass
class GroupBy(Sink):
    """A sink, or several by name, for each group; groups may be nested by giving another GroupBy.

    As a table: sinks that are aggregates give a row for each group, others the rows of their own tables; several by name of
    which some are no aggregates give a row for each group with an array for those. Every group of the rows before any
    filter of the sink appears, except in the rows of a sink's own table.
    """

    keys: Sequence[str | Column]
    sink: Any
    fused = False

    def _keyed(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        named = [(k if isinstance(k, str) else f"_g{i}_{len(df.columns)}", col(k)) for i, k in enumerate(self.keys)]
        new = {n: c for n, c in named if n not in df.columns}
        return (df.withColumns(new) if new else df), [n for n, _ in named]

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        src, own = self._keyed(df)
        own = [*keys, *own]
        if isinstance(self.sink, dict):
            from tidemill.plans.fork import fork_table

            return fork_table(src, self.sink, own) if all(s.fused for s in self.sink.values()) else self._side_by_side(src, own)
        return self.sink.table(src, own)

    def _side_by_side(self, df: DataFrame, own: Sequence[str]) -> DataFrame:
        """A row for each group: the fused sinks' columns from one aggregation, and a column for each of the others."""
        from tidemill.plans.fork import fused_columns

        named = {n: s for n, s in self.sink.items() if s.fused}
        out = df.groupBy(*own).agg(*[c for *_, c in fused_columns(named)]) if named else df.select(*own).distinct()
        for name, s in self.sink.items():
            if not s.fused:
                one = s.grouped(df, own)
                one = one.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], F.col(RESULT).alias(name))
                on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own)]
                out = out.join(one, on, "left").drop(*[f"_k{i}" for i in range(len(own))])
        return out

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        src, own = self._keyed(df)
        if isinstance(self.sink, dict):
            full = self._side_by_side(src, [*keys, *own])
            part = full.select(*keys, *own, F.struct(*[c for c in full.columns if c not in keys and c not in own]).alias(RESULT))
        else:
            part = self.sink.grouped(src, [*keys, *own])
        if not keys:
            return part
        return part.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(k) for k in own], F.col(RESULT))).alias(RESULT))

    def _value(self, result: Any) -> Any:
        if not isinstance(self.sink, dict):
            return self.sink.value(result)
        out = {}
        for name, s in self.sink.items():
            parts = list(s.columns()) if s.fused else []
            out[name] = s.finish({p: result[name if len(parts) == 1 else f"{name}_{p}"] for p in parts}) if s.fused else s.value(result[name])
        return out

    def value(self, result: Any) -> dict[Any, Any]:
        n = len(self.keys)
        return {r[0] if n == 1 else tuple(r[:n]): self._value(r[n]) for r in result or []}

    def run(self, df: DataFrame) -> dict[Any, Any]:
        if not isinstance(self.sink, GroupBy):
            return self.value(self.grouped(df, []).collect())
        # keys of nested groups side by side
        levels, src, own = [self], df, []
        while isinstance(levels[-1].sink, GroupBy):
            levels.append(levels[-1].sink)
        for g in levels:
            src, names = g._keyed(src)
            own += names
        return GroupBy(own, levels[-1].sink).run(src)
