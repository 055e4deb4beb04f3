"""Complete-link clusters of pairs that are the same, in one pass over them in order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = pa.schema([("id", pa.int64()), ("cluster", pa.int64())])


def _rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ids, of = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.int64())], schema=SCHEMA)


class Clusters:
    """The clusters of one block: of each id, and how many ids they hold."""

    def __init__(self):
        self.of: dict[int, int] = {}
        self.size: Counter[int] = Counter()

    def put(self, i: int, cluster: int) -> tuple[int, int]:
        self.of[i] = cluster
        self.size[cluster] += 1
        return i, cluster

    def join(self, i: int, before: list[int]) -> Iterator[tuple[int, int]]:
        """Places i, the next in order, which is the same as the ids ``before``; those that aren't placed yet are the same as
        none before them, so they have opened clusters. i fits a cluster if it is the same as all that it holds."""
        yield from [self.put(j, j) for j in before if j not in self.of]
        fits = [c for c, n in Counter(map(self.of.__getitem__, before)).items() if n == self.size[c]]
        yield self.put(i, fits[0] if len(fits) == 1 else i)


def complete_links(same: DataFrame, block: list[str]) -> DataFrame:
    """(id, cluster) of the ids in pairs (left_id < right_id, each once), which don't leave a block (columns without nulls): in order of ids, each joins
    the only cluster all of whose members it is the same as; if there are several, or none, it opens one.

    Pairs come sorted by block and later id, so a task holds the clusters of a block and the pairs of one id, never those of
    a group, and looks at each pair once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held, clusters = None, None, [], Clusters()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            keys, left, right = [batch.column(c) for c in block], batch.column("left_id").to_pylist(), batch.column("right_id").to_numpy()
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= pc.not_equal(k.slice(1), k.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = key != [k[0].as_py() for k in keys]
            starts = new.copy()
            starts[1:] |= right[1:] != right[:-1]
            starts[0] = new[0] or last != right[0]
            at = sorted({0, *np.flatnonzero(starts).tolist(), batch.num_rows})
            for a, b in zip(at, at[1:], strict=False):
                if starts[a] and held:
                    out += clusters.join(last, held)
                    held = []
                if new[a]:
                    clusters = Clusters()
                last = int(right[a])
                held += left[a:b]
            key = [k[-1].as_py() for k in keys]
            yield _rows(out)
        if held:
            yield _rows(list(clusters.join(last, held)))

    tasks = int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = same.select(F.xxhash64(*block).alias("_h"), *block, "left_id", "right_id")
    return keyed.repartition(tasks, *block).sortWithinPartitions("_h", *block, "right_id").mapInArrow(run, "id long, cluster long")
