"""Importance resampling towards a target distribution over hashed word n-grams.

A ring of running CRCs reads each document once: it holds the zlib state of the last n starts, and every further word
extends all of them by a space and the word, so each state is the CRC of a whole n-gram that is never built. What comes
out are buckets. Tasks add up their own counts, so Spark shuffles at most one row per task and bucket; the gains are one
number per bucket (their number is a parameter), and a second scan adds them up per document. Documents are drawn by
Gumbel keys, weight plus noise of the id, and ranked over range partitions, never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, release, table, unused

NGRAM = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text whose words are held at once, and of a batch.
SPAN, BATCH_BYTES = 1 << 20, 4 << 20
# A-Z lower-cased; all ASCII but digits and letters separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about SPAN bytes."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        to = text.find(b" ", at + SPAN) if len(text) - at > SPAN else -1
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def feature_crcs(run: list[bytes], ring: list[int], n: int) -> tuple[list[int], list[int]]:
    """(CRCs of all n-grams of up to n words that end in a word of the run, the ring after it); ring: states of the last starts."""
    crc32, out, keep = zlib.crc32, [], n - 1
    for word in run:
        if keep:
            further = b" " + word
            ring = [crc32(further, state) for state in ring[-keep:]]
        else:
            ring = []
        ring.append(crc32(word))
        out += ring
    return out, ring


def scan(text: str | None, n: int, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of each run of a text; a null text has none."""
    ring: list[int] = []
    for run in words((text or "").encode()):
        crcs, ring = feature_crcs(run, ring, n)
        yield len(run), np.array(crcs, np.uint32) % np.uint32(n_buckets)


def bucket_counts(docs: DataFrame, column: str = "text", n: int = NGRAM, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of all features of a text column; buckets without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for part in pieces(batches, column, BATCH_BYTES):
            for text in part.column(column):
                for _, buckets in scan(text.as_py(), n, n_buckets):
                    total += np.bincount(buckets, minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "count"])

    return docs.select(F.col(f"`{column}`")).mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's thousandths of log odds of target over source counts, both smoothed by one a bucket.

    The array that comes to the driver has one number per bucket, whatever the size of the tables.
    """
    spark = source.sparkSession
    every = spark.range(n_buckets).withColumnRenamed("id", "bucket")
    rows = every.join(source.withColumnRenamed("count", "s"), "bucket", "left").join(target.withColumnRenamed("count", "t"), "bucket", "left").fillna(0)
    held = rows.select("bucket", F.col("s").cast("double"), F.col("t").cast("double")).toPandas().sort_values("bucket")
    s, t = held["s"].to_numpy(), held["t"].to_numpy()
    odds = (t + 1.0) * (s.sum() + n_buckets) / ((s + 1.0) * (t.sum() + n_buckets))
    return np.floor(1000.0 * np.log(odds)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, column: str = "text", n: int = NGRAM) -> DataFrame:
    """docs without the text column, with n_words, n_features and weight (the sum of its features' gains), which replace
    columns of those names."""
    made = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c != column and c.lower() not in made]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({c: F.lit(0).cast("long") for c in made}).schema
    schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in pieces(batches, column, BATCH_BYTES):
            sums = np.zeros((3, part.num_rows), np.int64)
            for k, text in enumerate(part.column(column)):
                for n_words, buckets in scan(text.as_py(), n, len(own)):
                    sums[:, k] += n_words, len(buckets), own[buckets].sum()
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *map(pa.array, sums)], [*kept, *made])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, column]]).mapInArrow(run, schema)


def noise(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Thousandths of a Gumbel variate that the seed and the id fix; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = NGRAM, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs without text, with n_words, n_features, weight, score and rank (1, 2, ... of the documents drawn, else null).

    docs needs doc_id and text, target a text column. floor(percent * N / 100) of the N documents of least_words words and
    more are drawn, highest score first, ties to the smaller doc_id; a null id comes last. Repeated rows are documents of
    their own and interchangeable. Null and empty texts have no features, weight 0 and are not drawn; an empty target
    leaves the smoothing alone, an empty table gives no rows. Other columns of docs stay; of those named like a result the
    result stands.
    """
    results = ("n_words", "n_features", "weight", "score", "rank")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results])
    gain = gains(bucket_counts(docs, "text", n, n_buckets), bucket_counts(target, "text", n, n_buckets), n_buckets)
    scored = weigh(docs, gain, "text", n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    pid, row, before = (unused(scored, c) for c in ("_pid", "_row", "_before"))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    takes_part = F.col("n_words") >= least_words
    scored = scratch.save(scored)
    # Written with its partition, so the offsets are those of the rows wherever a task is run anew.
    dealt = scratch.save(scored.where(takes_part).repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    sizes = dealt.groupBy(pid).count()
    drawn = percent * dealt.count() // 100
    upto = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(pid, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(before))
    ranked = dealt.withColumn(row, F.row_number().over(Window.partitionBy(pid).orderBy(*order))).join(sizes, pid)
    rank = (F.col(row) + F.col(before)).cast("long")
    ranked = ranked.withColumn("rank", F.when(rank <= drawn, rank)).drop(pid, row, before)
    release(docs.sparkSession)
    return ranked.unionByName(scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target, Scratch(spark, "resampling")).select("doc_id", "n_features", "weight", "score", "rank")
