"""Near-duplicate embeddings by spherical-cap filters.

Filters are directions on the sphere with a product structure: after a random rotation a vector is halved, each half has
a codebook, and every pair of codewords is a direction. List decoding finds all directions whose cap holds a vector (inner
product at or above a level) from the inner products with the two codebooks alone; a vector in no cap of a code takes its
nearest direction there. Vectors that share a filter meet as bytes, one per component, with a proven bound of the
rounding; those that may be at the threshold are joined to candidate groups. Each vector of a group is fetched once, and
all pairs of a group are verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Scratch, table
from .vectors import class_ids, matrix, unit, usual_size

THRESHOLD = 0.95
#: Chance to miss a pair at the threshold that the filters are calibrated to.
MISS = 1e-3
#: Vectors a filter holds, about; vectors of a filter or group that meet in one task at most, about.
PER_FILTER, TOGETHER = 256, 1500
#: Caps of a code that a vector lies in, about.
CAPS = 0.5
#: Random vectors and pairs that the level and the number of codes are estimated on.
TRIALS = 1500
#: Rows of small filters, and of small groups, that one task takes, about.
TASK_ROWS = 20_000


class Filters:
    """Several product codes, each a rotation and two codebooks, and the level of the caps; deterministic by seed.

    A vector lies in about CAPS caps of a code; more vectors get more, narrower caps, so that filters stay small. The
    chance that two random vectors at the threshold share no filter of a code is estimated, and as many codes are made as
    bring it to ``miss`` for all of them. Neither the sample nor the memory grows with the vectors: the level is a
    quantile of TRIALS x 4,096 directions, where most of a code's directions can't be tried.
    """

    def __init__(self, n: int, dim: int, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.half, self.words = (dim + 1) // 2, int(np.clip(np.ceil(np.sqrt(n * max(CAPS, 1) / PER_FILTER)), 8, 4096))
        self.codes = [self.code(rng, dim)]
        x = unit(rng.normal(size=(TRIALS, dim)))
        y = rng.normal(size=x.shape)
        y = y - (y * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * (unit(y) if dim > 1 else 0)
        # The level: the share of directions above it, told from the sums of the words nearest to each vector.
        a, b = self.products(x, self.codes[0])
        k = min(self.words, 64)
        top = np.sort(a, axis=1)[:, -k:, None] + np.sort(b, axis=1)[:, None, -k:]
        above = min(int(CAPS * TRIALS), top.size - 1)
        self.level = float(np.partition(top.ravel(), top.size - 1 - above)[top.size - 1 - above])
        apart = sum(not len(np.intersect1d(p, q)) for p, q in zip(self.decode(x), self.decode(y), strict=True))
        self.missed = (apart + 1) / (len(x) + 2)
        self.codes += [self.code(rng, dim) for _ in range(max(0, int(np.ceil(np.log(miss) / np.log(self.missed))) - 1))]

    def code(self, rng: np.random.Generator, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.linalg.qr(rng.normal(size=(dim, dim)))[0], *(unit(rng.normal(size=(self.words, d))) for d in (self.half, max(1, dim - self.half)))

    def products(self, x: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = x @ code[0]
        second = x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))
        return x[:, : self.half] @ code[1].T, second @ code[2].T

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter number) of unit vectors, rows ascending within a code."""
        rows, ids = [], []
        for c, code in enumerate(self.codes):
            a, b = self.products(x, code)
            # Only words that reach the level with the best of the other half can be part of a direction that does.
            r, i = np.nonzero(a >= self.level - b.max(axis=1, keepdims=True))
            s, j = np.nonzero(b >= self.level - a.max(axis=1, keepdims=True))
            n = np.bincount(s, minlength=len(x))
            first = np.cumsum(n) - n
            times = n[r]
            at = np.repeat(first[r], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            r, i, j = np.repeat(r, times), np.repeat(i, times), j[at]
            ok = a[r, i] + b[r, j] >= self.level
            r, i, j = r[ok], i[ok], j[ok]
            none = np.setdiff1d(np.arange(len(x)), r)
            rows.append(np.concatenate([r, none]))
            ids.append(np.concatenate([i * self.words + j, a[none].argmax(axis=1) * self.words + b[none].argmax(axis=1)]) + c * self.words**2)
        return np.concatenate(rows), np.concatenate(ids)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filter numbers of each unit vector."""
        row, filter_ = self.pairs(x)
        order = np.lexsort((filter_, row))
        return np.split(filter_[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1]) if len(x) else []


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as bytes and the size of a step. With d components a vector is off by at most e = sqrt(d) / 2 steps, and
    an inner product by the sum and the product of both vectors' e."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), step


def _met(rows: pd.DataFrame, name: str) -> list[np.ndarray]:
    """Row numbers of each group of equal values of a column."""
    value = rows[name].to_numpy()
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(value[order][1:] != value[order][:-1]) + 1
    return np.split(order, cuts)


def _lowest(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that each of n nodes reaches over links i, j."""
    low = names.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (was == low).all():
            return low


def _blocks(rows: DataFrame, key: str, load: DataFrame, salt: str) -> DataFrame:
    """rows with (task, x, y, own): small groups of key share tasks; a group of many rows has a task of its own per pair of
    its blocks. load: (key, m), the rows of each group; only the large ones are joined."""
    total = load.agg(F.sum("m")).first()[0] or 0
    large = load.where(F.col("m") > TOGETHER).select(key, F.ceil(F.col("m") / TOGETHER).cast("int").alias("blocks"))
    held, none = rows.join(large, key, "left"), F.lit(-1)
    share = F.pmod(F.xxhash64(key), F.lit(max(1, total // TASK_ROWS)))
    some = held.where("blocks is null").select("*", share.alias("task"), none.alias("x"), none.alias("y"), none.alias("own"))
    many = held.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64(salt), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"task": F.col(key), "x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")
    return some.unionByName(many).drop("blocks")


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Links are pairs of rows with a cosine, in double precision, at or above threshold. Null and zero vectors, vectors that
    hold null or non-finite components or have another number of components than most of the table, and rows without an
    id link with nothing. Equal vectors are one class, told by a 64-bit hash, that meets others once. Rows that repeat a
    vec_id are vectors of their own. Filters and groups with many members are dealt over pairs of blocks. Only the two
    columns are read. An empty table gives an empty result.
    """
    dim = usual_size(vectors, column)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                at, x = matrix(part.column("v"), dim)
                ids = np.zeros(part.num_rows, np.int64)
                ids[at] = class_ids(x)
                none = np.ones(part.num_rows, bool)
                none[at] = False
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(ids, mask=none)], ["vec_id", "class"])

    every = rows.mapInArrow(name, "vec_id long, class long").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class"))
    every = scratch.save(every)
    classes = scratch.save(every.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    filters = Filters(classes.count(), max(dim, 1), threshold)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                _, x = matrix(batch.slice(a, 2000).column("v"), dim)
                ids = class_ids(x)
                fresh = np.array([c not in seen and not seen.add(c) for c in ids.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not fresh.any():
                    continue
                x, ids = unit(x[fresh]), ids[fresh]
                row, filter_ = filters.pairs(x)
                q, step = rounded(x)
                raw = q.tobytes()
                held = pa.array([raw[k * dim : (k + 1) * dim] for k in row.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(filter_), pa.array(ids[row]), pa.array(step[row].astype(np.float32)), held], ["filter", "class", "step", "q"])

    met = rows.where("vec_id is not null").select("v").mapInArrow(decode, "filter long, class long, step float, q binary")
    load = scratch.save(met.groupBy("filter").agg(F.count("*").alias("m")))
    tasks = _blocks(met, "filter", load, "class")

    def candidates(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        v = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), dim).astype(np.float32) * pdf["step"].to_numpy(np.float32)[:, None]
        off = np.sqrt(dim) / 2 * pdf["step"].to_numpy(np.float64)
        slack = (off + off * off / 2 + 1e-5).astype(np.float32)
        names, side = pdf["class"].to_numpy(), pdf["own"].to_numpy()
        found = []
        for rows in _met(pdf, "filter"):
            left, right = rows[side[rows] == x], rows[side[rows] == y]
            i, j = np.nonzero(v[left] @ v[right].T + slack[left][:, None] + slack[right][None] >= np.float32(threshold))
            i, j = left[i], right[j]
            ok = names[i] < names[j] if x == y else names[i] != names[j]
            i, j = i[ok], j[ok]
            if len(i):  # each to the smallest of those it reaches here, not all pairs
                own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                low = _lowest(len(own), at[: len(i)], at[len(i) :], names[own])
                found.append(np.stack([names[own], low])[:, names[own] != low])
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    edges = scratch.save(tasks.groupBy("task", "x", "y").applyInPandas(lambda k, p: candidates(k, p), "a long, b long"))
    groups = components(edges, scratch).withColumnsRenamed({"node": "class", "component": "group"})
    kind = "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                _, x = matrix(batch.slice(a, 4000).column("v"), dim)
                ids, at = np.unique(class_ids(x), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x[at].astype(kind)], pa.binary())], ["class", "v"])

    held = rows.where("vec_id is not null").select("v").mapInArrow(fetch, "class long, v binary")
    held = held.join(groups, "class").groupBy("class", "group").agg(F.first("v").alias("v")).join(classes.select("class", "n"), "class")
    held = scratch.save(held)
    def verify(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        v = unit(np.stack([np.frombuffer(b, kind) for b in pdf["v"]]).astype(np.float64))
        names, side, n = pdf["class"].to_numpy(), pdf["own"].to_numpy(), pdf["n"].to_numpy()
        links, low = np.zeros(len(pdf), np.int64), names.copy()
        for rows in _met(pdf, "group"):
            left, right = rows[side[rows] == x], rows[side[rows] == y]
            near = v[left] @ v[right].T >= threshold
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            if x == y:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            if len(own):
                low[own] = _lowest(len(own), at[: len(i)], at[len(i) :], names[own])
        some = links > 0
        return pd.DataFrame({"class": names[some], "links": links[some], "low": low[some]})

    pairs = _blocks(held, "group", held.groupBy("group").agg(F.count("*").alias("m")), "class").groupBy("task", "x", "y")
    found = scratch.save(pairs.applyInPandas(lambda k, p: verify(k, p), "class long, links long, low long"))
    near = found.groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("class").alias("a"), F.col("low").alias("b")), scratch).withColumnsRenamed({"node": "class"})
    whole = classes.join(near, "class", "left").join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lows = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = whole.join(lows, "component").select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = every.join(whole, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "caps"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c ON node = vec_id
"""
