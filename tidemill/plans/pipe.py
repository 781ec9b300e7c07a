"""Pipes: chains of steps without a source, to be applied to any table.

A step takes Column expressions, which Catalyst optimizes, or Python functions, which run over Arrow batches
(``explain`` of the result shows MapInArrow for them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from tidemill.operators import joins
from tidemill.operators.sinks import RESULT, Sink
from tidemill.types import as_schema

Step = Callable[[DataFrame], DataFrame]


def _rows(f: Callable[[Row], Iterable[Any]], schema: Any) -> Step:
    """Row by row in Python, in and out by Arrow batches; ``f`` gives the rows that stand for one."""
    out = as_schema(schema)
    if out is None:
        raise ValueError("a Python function needs the schema of what it gives")
    from pyspark.sql.pandas.types import to_arrow_schema

    names, arrow = out.names, to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            make = Row(*b.schema.names)
            rows = []
            for values in zip(*[c.to_pylist() for c in b.columns]) if b.num_columns else ():
                for x in f(make(*values)):
                    rows.append(x.asDict() if isinstance(x, Row) else x if isinstance(x, dict) else dict(zip(names, x if isinstance(x, tuple) else (x,))))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return lambda df: df.mapInArrow(run, out)


@dataclass(frozen=True)
class Pipe:
    steps: tuple[Step, ...] = ()

    def _then(self, step: Step) -> Pipe:
        return replace(self, steps=(*self.steps, step))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def map(self, *what: Any, schema: Any = None) -> Pipe:
        """One row for each row: Columns (or names), or one Python function of the row with its ``schema``."""
        if len(what) == 1 and callable(what[0]) and not isinstance(what[0], (Column, str)):
            f = what[0]
            return self._then(_rows(lambda r: (f(r),), schema))
        return self._then(lambda df: df.select(*what))

    def filter(self, predicate: Any) -> Pipe:
        """The rows for which the predicate (a Column, SQL text, or a function of the row) holds; a null doesn't."""
        if callable(predicate) and not isinstance(predicate, Column):
            return self._then(lambda df: _rows(lambda r: (r,) if predicate(r) else (), df.schema)(df))
        return self._then(lambda df: df.where(predicate))

    def flat_map(self, what: Any, alias: str = "value", schema: Any = None) -> Pipe:
        """Any number of rows for each row: an array Column, whose elements become rows of one column, or a function of the row."""
        if callable(what) and not isinstance(what, (Column, str)):
            return self._then(_rows(what, schema))
        return self._then(lambda df: df.select(F.explode(what).alias(alias)))

    def update(self, **columns: Column) -> Pipe:
        """The row with some columns changed."""
        return self._then(lambda df: df.withColumns({k: v for k, v in columns.items()}))

    def inspect(self, seen: Observation, *metrics: Column) -> Pipe:
        """Passes rows through, and observes aggregates of them on the way (``seen.get`` after the action)."""
        return self._then(lambda df: df.observe(seen, *metrics))

    def cloned(self) -> Pipe:
        return self

    def chain(self, other: DataFrame) -> Pipe:
        """These rows and those of another table of the same columns, without removal of repeats."""
        return self._then(lambda df: df.unionByName(other))

    def left_join(self, right: Any, on: Sequence[str], **how: Any) -> Pipe:
        return self._then(lambda df: joins.left_join(df, right, on, **how))

    def inner_join(self, right: Any, on: Sequence[str], **how: Any) -> Pipe:
        return self._then(lambda df: joins.inner_join(df, right, on, **how))

    def pipe(self, other: Any) -> Any:
        """This pipe and then another one, or then a sink."""
        if isinstance(other, Pipe):
            return Pipe(self.steps + other.steps)
        return Piped(self, other)


def _every(df: DataFrame, keys: Sequence[str], kept: DataFrame) -> DataFrame:
    """The results of ``kept`` for every group of ``df``; null for groups without one."""
    every = df.select(*keys).distinct().select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [F.col(f"_k{i}").eqNullSafe(F.col(f"`{k}`")) for i, k in enumerate(keys)]
    rest = [F.col(f"`{c}`") for c in kept.columns if c not in keys]
    return every.join(kept.withColumn("_has", F.lit(True)), on, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *rest, "_has")


@dataclass
class Piped(Sink):
    """A sink behind a pipe. Per group, groups whose rows the pipe drops still appear, with what the sink gives for no rows."""

    before: Pipe
    sink: Sink

    def __post_init__(self) -> None:
        self.fused = self.sink.fused and not self.before.steps

    @property
    def single(self) -> bool:
        return self.sink.single

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return self.sink.columns(keep)

    def finish(self, values: dict[str, Any]) -> Any:
        return self.sink.finish(values)

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        out = self.sink.table(self.before(df), keys)
        if not keys or not self.sink.fused:
            return out
        names = list(self.sink.columns())
        none = self.sink.table(self.before(df).limit(0))
        full = _every(df, keys, out).crossJoin(none.select(*[F.col(f"`{n}`").alias(f"_n_{n}") for n in names]))
        return full.select(*keys, *[F.when(F.col("_has"), F.col(f"`{n}`")).otherwise(F.col(f"_n_{n}")).alias(n) for n in names])

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        if not keys:
            return self.sink.grouped(self.before(df), keys)
        if self.sink.fused:
            full = self.table(df, keys)
            return full.select(*keys, F.struct(*[c for c in full.columns if c not in keys]).alias(RESULT))
        return _every(df, keys, self.sink.grouped(self.before(df), keys)).drop("_has")

    def value(self, result: Any) -> Any:
        return self.sink.value(result)

    def run(self, df: DataFrame) -> Any:
        return self.sink.run(self.before(df))


@dataclass
class Filtered(Sink):
    """A sink behind a filter; fused if the sink is: the condition goes into the aggregate. Per group, every group appears."""

    predicate: Column
    sink: Sink

    def __post_init__(self) -> None:
        self.fused = self.sink.fused

    @property
    def single(self) -> bool:
        return self.sink.single

    def columns(self, keep: Column | None = None) -> dict[str, Column]:
        return self.sink.columns(self.predicate if keep is None else keep & self.predicate)

    def finish(self, values: dict[str, Any]) -> Any:
        return self.sink.finish(values)

    def table(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        return super().table(df, keys) if self.fused else self.sink.table(df.where(self.predicate), keys)

    def grouped(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        if self.fused:
            return super().grouped(df, keys)
        kept = self.sink.grouped(df.where(self.predicate), keys)
        return _every(df, keys, kept).drop("_has") if keys else kept

    def value(self, result: Any) -> Any:
        return self.sink.value(result)

    def run(self, df: DataFrame) -> Any:
        return self.sink.run(df.where(self.predicate))


#: the pipe without steps
Identity = Pipe()
