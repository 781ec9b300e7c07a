"""Several sinks over one table.

All sinks that are aggregates are fused into one aggregation, one pass over the data. Only if others are among them is
the table persisted (memory, then disk) for the passes that they need.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemill.operators.sinks import Sink


def fused_columns(sinks: dict[str, Sink]) -> list[tuple[str, str, Any]]:
    """(sink's name, part, Column under the name of both) for each fused sink."""
    return [(name, part, c.alias(name if len(parts) == 1 else f"{name}_{part}")) for name, s in sinks.items() if s.fused for parts in [s.columns()] for part, c in parts.items()]


def fork_table(df: DataFrame, sinks: dict[str, Sink], keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one per group) with a column for each sink; only for sinks that are aggregates."""
    left = [n for n, s in sinks.items() if not s.fused]
    if left:
        raise ValueError(f"no single aggregates: {', '.join(left)}; use fork")
    cols = [c for _, _, c in fused_columns(sinks)]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def fork(df: DataFrame, sinks: dict[str, Sink] | Sequence[Sink]) -> Any:
    """What each sink gives, by name (or in order): one aggregation for the fused ones, one pass for each of the others."""
    named = dict(sinks) if isinstance(sinks, dict) else {f"s{i}": s for i, s in enumerate(sinks)}
    others = [n for n, s in named.items() if not s.fused]
    out: dict[str, Any] = {}
    mine = bool(others) and len(named) > 1 and not df.is_cached
    held = df.persist(StorageLevel.MEMORY_AND_DISK) if mine else df
    try:
        parts = fused_columns(named)
        if parts:
            row = held.agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(parts)]).first()
            for name in {n: None for n, _, _ in parts}:
                out[name] = named[name].finish({part: row[f"_{i}"] for i, (n, part, _) in enumerate(parts) if n == name})
        for name in others:
            out[name] = named[name].run(held)
    finally:
        if mine:
            held.unpersist(blocking=True)
    return {n: out[n] for n in named} if isinstance(sinks, dict) else tuple(out[n] for n in named)


