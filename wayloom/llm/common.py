"""Helpers shared by the operators: reading tables, scratch tables in the shared folder, byte batches."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Tables

#: Separators of words in every operator that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch(Tables):
    """Written tables that cut lineage. ``drop`` removes one early; the rest go when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        atexit.register(self.close)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of queries that have ended. Costs a full collection on the driver, a few
    tenths of a second; only called between stages that each shuffle a share of the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of a string column, or a single longer row. At the end of a task
    what Python and Arrow hold unused goes back, as workers stay for the tasks of other stages."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = strings(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
    give_back()


def give_back() -> None:
    """Returns memory that Python and Arrow hold unused."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (wraps)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


BASE = np.uint64(0x9E3779B97F4A7C55)
BACK = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n; the longest asked for so far is kept, 8 bytes each."""
    held = _POWERS.get(int(base))
    if held is None or len(held) <= n:
        held = np.empty(max(n, 1 << 20) + 1, np.uint64)
        held[0] = 1
        held[1:] = base
        held = _POWERS[int(base)] = np.multiply.accumulate(held, dtype=np.uint64)
        held.flags.writeable = False
    return held[: n + 1]


def by_row(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The order by row, then by h; rows are 0 .. n - 1. Two sorts, the second one of small numbers."""
    order = np.argsort(h)
    small = np.uint16 if n <= 1 << 16 else np.uint32
    return order[np.argsort(row[order].astype(small), kind="stable")]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes each as one value, byte-transposed, so that high zero bytes compress."""
    block = np.stack([c.astype(np.int64) for c in columns]).view(np.uint8)
    return len(columns[0]).to_bytes(8, "little") + block.reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()


def unpack(blobs: list[bytes], width: int) -> list[np.ndarray]:
    parts = []
    for b in blobs:
        n = int.from_bytes(b[:8], "little")
        parts.append(np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=8).reshape(width, 8, n).transpose(0, 2, 1)).view(np.int64)[:, :, 0])
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.int64)
    return list(whole)


def deal_out(columns: list[np.ndarray], key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed rows of that key), keys ascending."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), pack([c[a:b] for c in columns])


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
