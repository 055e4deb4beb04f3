"""Vectors in Arrow batches: reading list columns as matrices, telling which rows count and which are equal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_size(vectors: DataFrame, column: str) -> int:
    """The most frequent number of components in the table, of equally frequent ones the smallest; 0 if there is none."""
    size = F.size(column)
    first = vectors.where(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return first[0]["size"] if first else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): row numbers of vectors of dim components that are neither null nor zero and hold no null or
    non-finite component, and those vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    if not n or not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, max(dim, 1)))
    flat = column.take(pa.array(rows)).flatten()
    got = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)  # nulls become nan
    ok = np.isfinite(got).all(axis=1) & (np.abs(got).max(axis=1, initial=0) > 0)
    return rows[ok], got[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def class_ids(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row; equal vectors have one. A negative zero is a zero."""
    raw = np.ascontiguousarray(x + 0.0)
    return np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in raw], np.int64)
