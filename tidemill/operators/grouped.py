"""Opaque folds per group.

Each task folds the rows of its partition into one state per group, the states are shuffled by group, and merged where
they meet, in order of the group. A task holds at most ``most`` states at a time; beyond that it sends them on and starts
again, which an associative merge allows. Of a group that holds a third of all rows, one state a task is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: the column of the states, pickled
STATE = "_state"


def _same(key: tuple) -> tuple:
    """A key that equals itself also if NaN is in it."""
    return tuple(("nan",) if x != x else (x,) for x in key)


def grouped_fold(df: DataFrame, keys: Sequence[str], zero: Callable[[], Any], step: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], most: int = 10_000) -> DataFrame:
    """One row for each group: the keys and the pickled state (see load). Null keys are a group, NaN keys too."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(STATE, T.BinaryType())])
    arrow = to_arrow_schema(schema)
    names = df.columns
    at = [names.index(k) for k in keys]

    def batch(states: dict[tuple, tuple[tuple, Any]]) -> pa.RecordBatch:
        own = list(states.values())
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in own], arrow.field(i).type) for i in range(len(at))], pa.array([cloudpickle.dumps(s) for _, s in own], pa.binary())], schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Row(*names)
        states: dict[tuple, tuple[tuple, Any]] = {}
        for b in batches:
            for values in zip(*[c.to_pylist() for c in b.columns]):
                key = tuple(values[i] for i in at)
                same = _same(key)
                had = states.get(same)
                states[same] = (key, step(had[1] if had else zero(), make(*values)))
                if len(states) >= most:
                    yield batch(states)
                    states = {}
        yield batch(states)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple, tuple[tuple, Any]] = {}
        for b in batches:
            done: dict[tuple, tuple[tuple, Any]] = {}
            for *key, raw in zip(*[c.to_pylist() for c in b.columns]):
                same, state = _same(tuple(key)), pickle.loads(raw)
                if same in now:
                    now[same] = (now[same][0], merge(now[same][1], state))
                else:
                    done |= now
                    now = {same: (tuple(key), state)}
            yield batch(done)
        yield batch(now)

    states = df.mapInArrow(partial, schema)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, schema)


def load(raw: bytes) -> Any:
    return pickle.loads(raw)


def unpickled(df: DataFrame, name: str, kind: str) -> DataFrame:
    """The states as values of a type."""
    *keys, state = df.schema.fields
    schema = T.StructType([*keys, T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [pickle.loads(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values, arrow.field(len(keys)).type)], schema=arrow)

    return df.mapInArrow(run, schema)
