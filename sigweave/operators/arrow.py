"""Sorted groups of rows as Arrow tables of many whole groups, so that numpy takes them together and not one by one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a task takes together; a longer group makes a table alone.
ROWS = 1 << 17


def grouped(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """``rows`` dealt by ``keys``, none of them null, and sorted by these and ``order``; for ``mapInArrow`` with ``tables``."""
    return rows.dropna(subset=list(keys)).repartition(*keys).sortWithinPartitions(*keys, *order)


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each group of equal ``keys`` begins, and the end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        new |= pc.not_equal(table[k].slice(1), table[k].slice(0, len(new))).to_numpy()
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


def tables(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows in tables of whole groups, with ``starts``."""
    held, n, wanted = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = starts(table, keys)
        cut = int(begin[-2])  # the last group may go on
        if cut:
            yield table.slice(0, cut), begin[:-1]
        held = table.slice(cut).to_batches()
        n -= cut
        wanted = rows + n
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table, keys)


def alike(*numbers: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The places of equal ``numbers``, with these."""
    if not len(numbers[0]):
        return
    kinds, which = np.unique(np.stack(numbers, axis=1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for kind, at in zip(kinds, np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])):
        yield tuple(int(v) for v in kind), at


def repeated(table: pa.Table, keys: Sequence[str], at: np.ndarray, times: int) -> list[pa.Array]:
    """The ``keys`` of the rows ``at``, each ``times``."""
    return [table[k].combine_chunks().take(pa.array(np.repeat(at, times))) for k in keys]


def matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """[column, row] in doubles; a null is not a number."""
    return np.stack([table[c].to_numpy().astype(float, copy=False) for c in columns])
