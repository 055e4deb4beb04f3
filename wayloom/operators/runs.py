"""Small groups by the batch: rows come sorted by their key, whole groups at a time, so that a group costs no frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bounds(keys: list) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    return [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with their bounds; a group that may go on is held back until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = bounds(batch.column(key).to_pylist())
        if held and held[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py():
            first = at[1]
        else:
            first = 0
        if first == batch.num_rows or len(at) == 2 and not held:
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, at[-2])])
        held = [batch.slice(at[-2])]
        if done.num_rows:
            yield done, bounds(done.column(key).to_pylist())
    if held:
        done = pa.Table.from_batches(held)
        yield done, bounds(done.column(key).to_pylist())


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy()


def by_key(rows: DataFrame, key: str, f: Callable[[pa.Table, list[int]], pa.RecordBatch], schema: str, dealt: bool = False) -> DataFrame:
    """``f`` over whole groups of equal keys: a table of some and where each begins. dealt: rows of a key
    stand together in one partition already, sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, key):
            yield f(table, at)

    return (rows if dealt else rows.repartition(key).sortWithinPartitions(key)).mapInArrow(run, schema)
