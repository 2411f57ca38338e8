"""Rules that take a key's rows in order, in one pass over sorted partitions.

Rows are dealt by their keys and sorted; a rule then sees them batch after batch and holds what it may still need - a survivor,
the rows within a tolerance - but never a key's rows as a whole.  Time is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Row = tuple


def dealt(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _leaves(column: pa.Array) -> Iterator[pa.Array]:
    if pa.types.is_struct(column.type):
        yield column.is_valid()
        for part in column.flatten():
            yield from _leaves(part)
    else:
        yield column


def changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Whether a row's keys, the first columns, differ from those of the row before; true for the first row."""
    n = len(batch)
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for k in range(n_keys):
            for leaf in _leaves(batch.column(k)):
                a, b = leaf.slice(0, n - 1), leaf.slice(1)
                both = pc.and_(pc.is_null(a), pc.is_null(b))
                out[1:] |= pc.if_else(both, False, pc.fill_null(pc.not_equal(a, b), True)).to_numpy(zero_copy_only=False)
    return out


def more(a, b) -> bool:
    """a > b, false for nulls."""
    return a is not None and b is not None and a > b


def survivors(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], step: Callable[[Row, object, Row], tuple[bool, bool]]) -> DataFrame:
    """The rows that survive in each key, by the columns keys and values, in the order of values.

    step(current, anchor, row) says whether a row joins the current survivor, and whether it takes its place; rows are tuples of values, and the anchor
    is the first value of the row that opened the survivor's cluster.
    """
    chosen = df.select(*keys, *values)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor = None, None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            new = changes(batch, n_keys).tolist()
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys, batch.num_columns))))
            kept, at, cur = [], 0, rows[0]
            anchor = cur[0] if held is None else anchor
            for i in range(1, len(rows)):
                x = rows[i]
                joins, replaces = (False, False) if new[i] else step(cur, anchor, x)
                if not joins:
                    kept.append(at)
                    at, cur, anchor = i, x, x[0]
                elif replaces:
                    at, cur = i, x
            yield batch.take(pa.array(kept, pa.int64()))
            held = batch.slice(at, 1)
        if held is not None:
            yield held

    return dealt(chosen, keys, values[:2]).mapInArrow(run, chosen.schema)


def each_key(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], order: tuple[str, ...], make: Callable[[Callable], tuple[Callable[[Row], None], Callable[[], None]]], schema: str) -> DataFrame:
    """Rows that a rule makes of each key's rows in order: the keys, then the rule's columns (of `schema`, longs all of them).

    make(emit) returns (take, end): take gets a row, end is called after a key's last one, emit gets a tuple of the schema.
    """
    chosen = df.select(*keys, *values)
    n_keys, names = len(keys), [*keys, *(c.split()[0] for c in schema.split(", "))]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:n_keys]), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made: list[tuple] = []
        take, end = make(made.append)
        key, kinds = None, None

        def flush(key) -> None:
            out.extend((*key, *x) for x in made)
            made.clear()

        def batch_of() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)] or [[] for _ in names]
            out.clear()
            types = [*kinds, *[pa.int64()] * (len(names) - n_keys)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            if not len(batch):
                continue
            kinds = [batch.schema.field(i).type for i in range(n_keys)]
            new = changes(batch, n_keys)
            heads = dict(zip(np.flatnonzero(new).tolist(), zip(*(batch.column(i).take(pa.array(np.flatnonzero(new))).to_pylist() for i in range(n_keys)))))
            for i, x in enumerate(zip(*(batch.column(i).to_pylist() for i in range(n_keys, batch.num_columns)))):
                if i in heads and heads[i] != key:
                    if key is not None:
                        end()
                        flush(key)
                    key = heads[i]
                take(x)
            flush(key)
            yield batch_of()
        if key is not None:
            end()
            flush(key)
            yield batch_of()

    return dealt(chosen, keys, order).mapInArrow(run, fields)
