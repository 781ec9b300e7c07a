"""Sessions of each entity's activity, cut from a Cartesian tree over its gaps.

An entity's events, in order of time, are leaves; between neighbours lies a gap.
The Cartesian tree has the largest gap at its root, and left and right of it the
trees of the two sides; equal gaps with no larger one between them share a node.
Each node covers a stretch of events and knows the gap of its parent, so the
sessions for *any* threshold are those nodes whose own gap is at most the
threshold and whose parent's is larger: one filter over the stored forest.

At scale: events are first counted per entity and second, so that no group of
(entity, chunk of time) can hold more rows than a chunk has seconds, however hot
the entity. Each chunk's tree is built on its own. What can still change when
chunks are put together is only its two spines, at most about sqrt(2 x chunk
seconds) distinct gaps each; these few items are merged per entity by the same
builder. Partial forests of separate days or files merge in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import materialize

_NODE = [("gap_s", "bigint"), ("parent_gap_s", "bigint"), ("start_s", "bigint"), ("end_s", "bigint"), ("n_events", "bigint"), ("leaf", "boolean"), ("open", "boolean")]
_COLS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


class _Tree:
    """Builds the tree of one entity from items in order of time; the stack is the tree's right spine."""

    __slots__ = ("emit", "stack", "first", "gap", "lo", "hi", "n", "leaf", "key")

    def __init__(self, emit: Callable, key: int, lo: int, hi: int, n: int, leaf: bool) -> None:
        self.emit, self.key, self.stack, self.first = emit, key, [], lo
        self.gap, self.lo, self.hi, self.n, self.leaf = 0, lo, hi, n, leaf

    def add(self, lo: int, hi: int, n: int, leaf: bool) -> None:
        g, stack, emit, key = lo - self.hi, self.stack, self.emit, self.key
        cgap, clo, chi, cn, cleaf = self.gap, self.lo, self.hi, self.n, self.leaf
        while stack and stack[-1][0] < g:
            pgap, plo, pn = stack.pop()
            emit(key, cgap, pgap, clo, chi, cn, cleaf)
            cgap, clo, cn, cleaf = pgap, plo, pn + cn, False
        emit(key, cgap, g, clo, chi, cn, cleaf)
        if stack and stack[-1][0] == g:
            stack[-1][2] += cn
        else:
            stack.append([g, clo, cn])
        self.gap, self.lo, self.hi, self.n, self.leaf = 0, lo, hi, n, leaf

    def close(self) -> None:
        cgap, clo, chi, cn, cleaf = self.gap, self.lo, self.hi, self.n, self.leaf
        while self.stack:
            pgap, plo, pn = self.stack.pop()
            self.emit(self.key, cgap, pgap, clo, chi, cn, cleaf)
            cgap, clo, cn, cleaf = pgap, plo, pn + cn, False
        self.emit(self.key, cgap, None, clo, chi, cn, cleaf)


def _spine_items(nodes: list[tuple], first: int, last: int) -> list[tuple[int, int, int, bool]]:
    """The items (start, end, events, leaf) between the spine gaps of a chunk, from its open nodes.

    ``nodes`` are (gap, start, end, events, leaf) of the nodes that touch the chunk's first or last event.
    The root's gap parts the left spine from the right one.
    """
    left = sorted((x for x in nodes if x[1] == first and x[2] < last), key=lambda x: x[0])
    right = sorted((x for x in nodes if x[2] == last and x[1] > first), key=lambda x: x[0])
    root = next(x for x in nodes if x[1] == first and x[2] == last)
    if root[4]:  # a single leaf is all
        return [(first, last, root[3], True)]
    out, end, n = [], None, 0
    for gap, _, hi, k, leaf in left:
        out.append((first if end is None else end + gap, hi, k - n, leaf))
        end, n = hi, k
    tail, start, m = [], None, 0
    for gap, lo, _, k, leaf in right:
        tail.append((lo, last if start is None else start - gap, k - m, leaf))
        start, m = lo, k
    gap, middle = root[0], root[3] - n - m
    if middle:
        out.append((end + gap, start - gap, middle, False))
    return out + tail[::-1]


def _forest(n_keys: int, chunked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by the keys, (the chunk,) and time: the nodes of each key's tree.

    With ``chunked``, the nodes at a chunk's edges are given as spine items, marked open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        at, add = out, [x.append for x in out]
        keep: list[tuple] = []  # the current chunk's open nodes
        tree: _Tree | None = None
        held: list[pa.Array] = []  # key values by number: one slice for each batch
        rows: list[int] = []  # of each key: its row in the batch's slice
        names: list[str] = []

        def emit_all(key: int, gap: int, parent: int | None, lo: int, hi: int, n: int, leaf: bool) -> None:
            if gap == 0 and not leaf:
                return  # an item that stands for several subtrees, given before
            for f, v in zip(add, (key, gap, parent, lo, hi, n, leaf, False)):
                f(v)

        def emit_chunk(key: int, gap: int, parent: int | None, lo: int, hi: int, n: int, leaf: bool) -> None:
            if lo == tree.first or tree.closing:
                keep.append((gap, lo, hi, n, leaf))
            else:
                for f, v in zip(add, (key, gap, parent, lo, hi, n, leaf, False)):
                    f(v)

        class Chunk(_Tree):
            __slots__ = ("closing",)

            def __init__(self, *a: object) -> None:
                super().__init__(*a)
                self.closing = False

        def end() -> None:
            if tree is None:
                return
            if chunked:
                tree.closing = True
                tree.close()
                for lo, hi, n, leaf in _spine_items(keep, tree.first, tree.hi):
                    for f, v in zip(add, (tree.key, None, None, lo, hi, n, leaf, True)):
                        f(v)
                keep.clear()
            else:
                tree.close()

        def flush() -> pa.RecordBatch:
            table = [pa.concat_arrays([h[i] for h in held]) if len(held) > 1 else held[0][i] for i in range(n_keys)]
            take = pa.array(at[0], pa.int64())
            cols = [t.take(pa.array(rows, pa.int64())).take(take) for t in table] + [pa.array(v, kind) for v, kind in zip(at[1:], _COLS)]
            for x in at:
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        base = 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema.names[:n_keys] + [c for c, _ in _NODE]
            keys = [b.column(i) for i in range(n_keys)]
            same = np.ones(b.num_rows, bool)
            for i in range(n_keys + chunked):
                codes = pc.dictionary_encode(b.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same[1:] &= codes[1:] == codes[:-1]
            same[0] = tree is not None and all(b.column(i)[0].as_py() == x for i, x in enumerate(prev))
            held.append(keys)
            lo, hi, n, leaf = (b.column(n_keys + chunked + i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
            for r, (s, a, z, k, l) in enumerate(zip(same.tolist(), lo, hi, n, leaf)):
                if s:
                    tree.add(a, z, k, l)
                else:
                    end()
                    rows.append(base + r)
                    tree = Chunk(emit_chunk, len(rows) - 1, a, z, k, l) if chunked else _Tree(emit_all, len(rows) - 1, a, z, k, l)
            prev = [b.column(i)[b.num_rows - 1].as_py() for i in range(n_keys + chunked)]
            base += b.num_rows
            if len(at[0]) >= 20_000:
                yield flush()
                # only the current key's values are needed from here on
                current = [pa.array([keys[i][b.num_rows - 1].as_py()], keys[i].type) for i in range(n_keys)]
                held, rows, base = [current], [0], 1
                tree.key = 0
        if tree is not None:
            end()
            if at[0]:
                yield flush()

    return run


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole epoch seconds, rounded down, of a timestamp column (without zone: as UTC); other types are cast to bigint."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        # from its parts: a difference of times without zone would go through the session's zone
        return (F.unix_date(col.cast("date")).cast("bigint") * 86_400 + F.hour(col) * 3_600 + F.minute(col) * 60 + F.second(col)).cast("bigint")
    if isinstance(kind, T.TimestampType):
        micros = F.unix_micros(col)
        return ((micros - F.pmod(micros, F.lit(1_000_000))) / F.lit(1_000_000)).cast("bigint")
    return col.cast("bigint")


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    kinds = {"bigint": T.LongType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(c, kinds[k]) for c, k in _NODE])


def chunk_forest(events: DataFrame, keys: list[str], time_col: str, *, drop_null: tuple[str, ...] = (), chunk_seconds: int = 86_400) -> DataFrame:
    """The trees of each (entity, chunk of time): finished nodes, and the spine items that are still open.

    Columns: the keys, gap_s, parent_gap_s, start_s, end_s, n_events, leaf, open. Rows with a null time, or a
    null in one of ``drop_null``, are left out; a null in another key is a value of its own. Other columns of
    ``events`` are ignored. An empty table gives an empty forest.
    """
    if chunk_seconds < 1:
        raise ValueError("chunk_seconds must be at least 1")
    src = events.where(F.col(f"`{time_col}`").isNotNull())
    for k in drop_null:
        src = src.where(F.col(f"`{k}`").isNotNull())
    cols = [F.col(f"`{k}`") for k in keys]
    counted = src.select(*cols, epoch_seconds(events, time_col).alias("_s")).groupBy(*cols, "_s").agg(F.count(F.lit(1)).alias("_n"))
    rows = counted.select(*cols, F.floor(F.col("_s") / F.lit(chunk_seconds)).cast("bigint").alias("_chunk"), "_s", F.col("_s").alias("_e"), "_n", F.lit(True).alias("_leaf"))
    placed = rows.repartition(*cols, "_chunk").sortWithinPartitions(*cols, "_chunk", "_s")
    return placed.mapInArrow(_forest(len(keys), True), _schema(events, keys))


def merge_forests(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks put together: all nodes, each with the gap of its parent (null at an entity's root).

    ``parts`` is the output of chunk_forest, written; or a union of several whose chunks don't overlap.
    Only the spine items are shuffled.
    """
    cols = [F.col(f"`{k}`") for k in keys]
    done = parts.where(~F.col("open"))
    items = parts.where(F.col("open")).select(*cols, "start_s", "end_s", "n_events", "leaf")
    placed = items.repartition(*cols).sortWithinPartitions(*cols, "start_s")
    return done.unionByName(placed.mapInArrow(_forest(len(keys), False), _schema(parts, keys))).drop("open", "leaf")


def gap_forest(events: DataFrame, keys: list[str], time_col: str, *, drop_null: tuple[str, ...] = (), chunk_seconds: int = 86_400) -> DataFrame:
    """The whole forest: keys, gap_s, parent_gap_s, start_s, end_s, n_events. The chunks' trees are written once in between."""
    parts = chunk_forest(events, keys, time_col, drop_null=drop_null, chunk_seconds=chunk_seconds)
    return merge_forests(materialize(parts, "gap-forest"), keys)


def cut(forest: DataFrame, gap_seconds: int) -> DataFrame:
    """The sessions at one threshold: a new one starts when more than ``gap_seconds`` have passed.

    Columns: the keys, start_s, end_s, duration_s, n_events.
    """
    keep = (F.col("gap_s") <= gap_seconds) & (F.col("parent_gap_s").isNull() | (F.col("parent_gap_s") > gap_seconds))
    keys = [c for c in forest.columns if c not in {n for n, _ in _NODE}]
    return forest.where(keep).select(*[F.col(f"`{k}`") for k in keys], "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n_events")
