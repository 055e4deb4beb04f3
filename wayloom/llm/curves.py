"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, each shifted at random, and ordered along the
Hilbert curve of each. Spark range-partitions the orders, so a vector's rank on a curve is known; a query's candidates are
the vectors within a window of ranks on any curve. Windows are met in blocks of the orders, where cosines are matrix
products, and the best of all blocks merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import class_ids, matrix, unit, usual_size

CURVES, DIMENSIONS, BITS = 4, 4, 8
#: Share of all vectors to either side of a query that its window holds on each curve, and the least window.
WINDOW, LEAST_WINDOW = 0.2, 300
#: Rows of a curve that form a block, queries that meet a block in one task at most, about.
BLOCK, QUERIES = 2048, 4096
#: Vectors that the projections are centred and scaled on: the lowest by a hash of vec_id.
SAMPLE_ROWS = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows, dimensions) of 2**bits per side (Skilling's transform)."""
    x = cells.T.astype(np.uint64)
    one, n = np.uint64(1), len(cells.T)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        p = q - one
        for i in range(n):
            far = (x[i] & q) > 0
            swap = np.where(far, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(far, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        t ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(level)) & one
    return key.astype(np.int64)


class Curves:
    """Projections, their scale and shift; fitted on a bounded sample, deterministic by seed."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        k = min(dimensions, dim)
        self.bits, self.dim = bits, dim
        self.frames = [np.linalg.qr(rng.normal(size=(dim, k)))[0] for _ in range(curves)]
        self.shifts = [rng.random(k) for _ in range(curves)]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        self.scale = [np.maximum(((sample - self.mean) @ f).std(axis=0), 1e-9) if len(sample) else np.ones(k) for f in self.frames]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        side = 1 << self.bits
        out = []
        for frame, shift, scale in zip(self.frames, self.shifts, self.scale, strict=True):
            y = (x - self.mean) @ frame / scale
            even = 1 / (1 + np.exp(-1.702 * np.clip(y, -30, 30)))  # about the normal distribution function
            out.append(hilbert(((even * 0.75 + shift * 0.25) * side).astype(np.int64).clip(0, side - 1), self.bits))
        return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y in double precision, whatever rows surround them. Rows are scaled by powers
    of two, which changes no digit and keeps sums finite."""
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1, keepdims=True, initial=0))[1]) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def nearest(vectors: DataFrame, scratch: Scratch, every: int = 50, k: int = 5, id_column: str = "vec_id", column: str = "embedding", window: float = WINDOW, least: int = LEAST_WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Nearness is the cosine in double precision of the original vectors; ties go to the smaller id. Equal vectors are one
    class on the curves, so copies cost no places in a window, and a class's smallest ids stand for it. A row is never its
    own neighbour; another row of its id may be, and each row of a repeated id is a query of its own. Vectors that are
    null, zero, of another number of components than most of the table or hold null or non-finite components take no
    part, nor do rows without an id. Tables of up to ``least`` different vectors are searched whole. Only the two columns
    are read. An empty table gives an empty result.
    """
    dim = usual_size(vectors, column)
    kind = "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v")).where("vec_id is not null")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    curves = Curves(unit(matrix(few, dim)[1]))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                at, x = matrix(part.column("v"), dim)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(at)), pa.array(class_ids(x))], ["vec_id", "class"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                at, x = matrix(part.column("v"), dim)
                own = part.column("vec_id").to_numpy()[at]
                ids, of = np.unique(class_ids(x), return_inverse=True)
                low, asked = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), bool)
                np.minimum.at(low, of, own)
                np.logical_or.at(asked, of, own % every == 0)
                first = np.full(len(ids), len(x))
                np.minimum.at(first, of, np.arange(len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low), pa.array(asked), pa.array([r.tobytes() for r in x[first].astype(kind)], pa.binary())], ["class", "low", "asked", "v"])

    named = scratch.save(rows.mapInArrow(name, "vec_id long, class long"))
    classes = rows.mapInArrow(distinct, "class long, low long, asked boolean, v binary")
    classes = scratch.save(classes.groupBy("class").agg(F.min("low").alias("low"), F.max("asked").alias("asked"), F.first("v").alias("v")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                x = np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                for c, key in enumerate(curves.keys(unit(x))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), part.column("class")], ["curve", "key", "class"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pid = {}, TaskContext.get().partitionId()
        for batch in batches:
            c = batch.column("curve").to_numpy()
            seq = np.empty(len(c), np.int64)
            for one in np.unique(c):
                own = c == one
                seq[own] = seen.get(one, 0) + np.arange(own.sum())
                seen[one] = seen.get(one, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("class"), pa.array(np.full(len(c), pid, np.int32)), pa.array(seq)], ["curve", "class", "pid", "seq"])

    # Only keys are ordered; classes of one key stand in another order on each curve.
    placed = classes.select("class", "v").mapInArrow(place, "curve int, key long, class long").withColumn("tie", F.xxhash64("curve", "class"))
    dealt = placed.repartitionByRange("curve", "key", "tie").sortWithinPartitions("curve", "key", "tie")
    ordered = scratch.save(dealt.select("curve", "class").mapInArrow(number, "curve int, class long, pid int, seq long"))
    n = classes.count()
    reach = max(least, math.ceil(window * n))
    chunks = max(1, math.ceil(2 * reach / every / QUERIES))
    upto = Window.partitionBy("curve").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per curve and partition
    offsets = ordered.groupBy("curve", "pid").count().select("curve", "pid", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("offset"))
    ranks = ordered.join(offsets, ["curve", "pid"]).groupBy("class").agg(F.collect_list(F.struct("curve", (F.col("seq") + F.col("offset")).alias("rank"))).alias("places"))
    ranked = classes.join(ranks, "class").select("class", "low", "asked", "v", F.explode("places").alias("p")).select("class", "low", "asked", "v", "p.curve", "p.rank")
    held = ranked.select("curve", F.floor(F.col("rank") / BLOCK).alias("block"), "class", "low", "v", "rank", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    low, high = F.greatest(F.col("rank") - reach, F.lit(0)), F.least(F.col("rank") + reach, F.lit(max(n - 1, 0)))
    blocks = F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK)))
    asking = ranked.where("asked").select(F.col("curve").alias("q_curve"), blocks.alias("q_block"), F.col("class").alias("q"), F.col("v").alias("q_v"), F.col("rank").alias("q_rank"), F.pmod(F.xxhash64("class"), F.lit(chunks)).cast("int").alias("q_chunk"))

    def meet(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((4, 0))]
        if len(q) and len(c):
            x, y = (np.stack([np.frombuffer(v, kind) for v in t]).astype(np.float64) for t in (q["q_v"], c["v"]))
            u, w = unit(x), unit(y)
            ids, ranks, lows = c["class"].to_numpy(), c["rank"].to_numpy(), c["low"].to_numpy()
            own, at = q["q"].to_numpy(), q["q_rank"].to_numpy()
            for a in range(0, len(q), 512):
                s = u[a : a + 512] @ w.T
                s[np.abs(at[a : a + 512, None] - ranks) > reach] = -np.inf
                edge = np.partition(s, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] if len(ids) > k + 1 else np.full(len(s), -2.0)
                i, j = np.nonzero((s >= edge[:, None] - 1e-9) & (s > -np.inf))  # the product's last digits depend on the block
                score = cosines(x[a + i], y[j])
                order = np.lexsort((lows[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, np.arange(len(s)))
                keep = np.arange(len(i)) - first[i] <= k  # the query's own class may be one of them
                out.append(np.stack([own[a + i], ids[j], lows[j], score.view(np.int64)])[:, keep])
        q_, c_, low_, score_ = np.concatenate([z.astype(np.int64) for z in out], axis=1)
        return pd.DataFrame({"q": q_, "class": c_, "low": low_, "score": score_.view(np.float64)})

    found = asking.groupBy("q_curve", "q_block", "q_chunk").cogroup(held.groupBy("curve", "block", "chunk")).applyInPandas(lambda key, q, c: meet(key, q, c), "q long, class long, low long, score double")
    best = found.groupBy("q", "class", "low").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # Classes become rows again: the smallest ids of each, as many as could be asked for.
    least_ids = Window.partitionBy("class").orderBy("vec_id")
    members = named.withColumn("n", F.row_number().over(least_ids)).where(F.col("n") <= k + 1).select("class", "vec_id")
    lists = best.join(members, "class").groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", (F.col("class") != F.col("q")).alias("other")))).alias("near"))
    asked = named.where(F.col("vec_id") % every == 0).select(F.col("class").alias("q"), F.col("vec_id").alias("query_id")).join(lists, "q")
    own = F.expr("coalesce(array_position(transform(near, x -> not x.other and x.vec_id = query_id), true), 0)")
    rest = asked.withColumn("own", own).withColumn("near", F.expr("slice(if(own > 0, concat(slice(near, 1, own - 1), slice(near, own + 1, size(near))), near), 1, " + str(k) + ")"))
    flat = rest.select("query_id", F.posexplode("near").alias("pos", "x"))
    return flat.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "nearest"))
