"""Flow: a table with the lazy transforms of a pipe and the terminal operators as methods."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from tidemill.operators import sinks as S
from tidemill.plans import fork as _fork
from tidemill.plans.pipe import Identity, Pipe
from tidemill.types import as_schema


class Flow:
    """Immutable; each transform gives a new one. ``df`` is the DataFrame behind it."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[Any], schema: Any = None) -> Flow:
        from tidemill.sources.memory import parallelize

        return cls(parallelize(spark, rows, as_schema(schema)))

    def _by(self, step: Callable[..., Pipe], *a: Any, **k: Any) -> Flow:
        return Flow(step(*a, **k)(self.df))

    def map(self, *what: Any, schema: Any = None) -> Flow:
        return self._by(Identity.map, *what, schema=schema)

    def filter(self, predicate: Any) -> Flow:
        return self._by(Identity.filter, predicate)

    def flat_map(self, what: Any, alias: str = "value", schema: Any = None) -> Flow:
        return self._by(Identity.flat_map, what, alias, schema)

    def update(self, **columns: Column) -> Flow:
        return self._by(Identity.update, **columns)

    def inspect(self, seen: Any, *metrics: Column) -> Flow:
        return self._by(Identity.inspect, seen, *metrics)

    def cloned(self) -> Flow:
        return self

    def chain(self, other: Flow | DataFrame) -> Flow:
        return self._by(Identity.chain, other.df if isinstance(other, Flow) else other)

    def left_join(self, right: Any, on: Sequence[str], **how: Any) -> Flow:
        return self._by(Identity.left_join, right.df if isinstance(right, Flow) else right, on, **how)

    def inner_join(self, right: Any, on: Sequence[str], **how: Any) -> Flow:
        return self._by(Identity.inner_join, right.df if isinstance(right, Flow) else right, on, **how)

    def pipe(self, what: Any) -> Any:
        """Through a pipe: another Flow. Into a sink: what it gives."""
        return Flow(what(self.df)) if isinstance(what, Pipe) else what.run(self.df)

    def fork(self, *sinks: S.Sink, **named: S.Sink) -> Any:
        return _fork.fork(self.df, named or list(sinks))

    def agg(self, **sinks: S.Sink) -> DataFrame:
        """One row with a column for each sink, as a table."""
        return _fork.fork_table(self.df, sinks)

    def group(self, *keys: str, **sinks: S.Sink) -> DataFrame:
        """One row for each group with a column for each sink, as a table."""
        return _fork.fork_table(self.df, sinks, keys)

    def table(self, sink: S.Sink) -> DataFrame:
        return sink.table(self.df)

    def count(self) -> int:
        return S.Count().run(self.df)

    def sum(self, x: Any) -> Any:
        return S.Sum(x).run(self.df)

    def mean(self, x: Any) -> float | None:
        return S.Mean(x).run(self.df)

    def stddev(self, x: Any) -> float | None:
        return S.StdDev(x).run(self.df)

    def max(self, x: Any) -> Any:
        return S.Max(x).run(self.df)

    def min(self, x: Any) -> Any:
        return S.Min(x).run(self.df)

    def max_by(self, x: Any, key: Any, tiebreak: Sequence[Any] = ()) -> Any:
        return S.MaxBy(x, key, tiebreak).run(self.df)

    def min_by(self, x: Any, key: Any, tiebreak: Sequence[Any] = ()) -> Any:
        return S.MinBy(x, key, tiebreak).run(self.df)

    max_by_key, min_by_key = max_by, min_by

    def combine(self, x: Any, f: Any) -> Any:
        return S.Combine(x, f).run(self.df)

    def fold(self, zero: Callable[[], Any], step: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any]) -> Any:
        return S.Fold(zero, step, merge).run(self.df)

    def histogram(self, x: Any) -> list[tuple[Any, int]]:
        return S.Histogram(x).run(self.df)

    def group_by(self, keys: Sequence[Any], sink: Any) -> dict[Any, Any]:
        return S.GroupBy(keys, sink).run(self.df)

    def sort_n_by(self, n: int, *order: Any) -> list[Any]:
        return S.SortN(n, order).run(self.df)

    def most_frequent(self, x: Any, n: int, probability: float = 0.99, tolerance: float = 0.002, exact: bool = False) -> list[tuple[Any, int]]:
        return S.MostFrequent(x, n, probability, tolerance, exact).run(self.df)

    def most_distinct(self, key: Any, x: Any, n: int, probability: float = 0.99, tolerance: float = 0.002, error_rate: float = 0.02, exact: bool = False) -> list[tuple[Any, int]]:
        return S.MostDistinct(key, x, n, probability, tolerance, error_rate, exact).run(self.df)

    def sample_unstable(self, n: int, seed: int = 0) -> list[Any]:
        return S.Sample(n, seed).run(self.df)

    def all(self, predicate: Column) -> bool:
        return S.All(predicate).run(self.df)

    def any(self, predicate: Column) -> bool:
        return S.Any_(predicate).run(self.df)

    def for_each(self, f: Callable[[Any], None]) -> None:
        S.ForEach(f).run(self.df)

    def collect(self, into: str = "list", **how: Any) -> Any:
        return S.Collect(into, **how).run(self.df)
