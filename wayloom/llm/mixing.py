"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size. Documents are laid in a line per
source, ordered by size, so that the line's prefix sum is rank x copies; one random offset per source is added and a
document is emitted once per integer boundary that its stretch crosses. Ordering by size spreads every size class
evenly, which keeps the words taken within about one document of the target.

No source is gathered in one task. Ranks come from counts of cells (source, size, bucket of doc_id) and a row number
within a cell; a window over a source only sees one row per distinct size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, word_count

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents of one size and source that share a bucket at most, about.
PER_BUCKET = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (key, words): each source's target and the copies that its documents expect.

    Sources sorted by most x words / weight: those that reach their cap are a prefix of that order. The window sees one
    row per source.
    """
    by_key, every = Window.orderBy("key"), Window.partitionBy()
    cap = F.lit(float(most)) * F.col("words")
    order = Window.orderBy("reach", "key")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_key) - 1) % n + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("reach", cap / F.col("weight"))
        .withColumn("left_words", F.sum("words").over(every) - F.coalesce(F.sum(cap).over(upto), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("stop", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "key", "level"))).over(every))
        .withColumn("target", F.when(F.struct("reach", "key") < F.struct("stop.reach", "stop.key"), cap).otherwise(F.least(cap, F.col("stop.level") * F.col("weight"))))
        .select("key", F.col("words").alias("source_size"), "target", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0).alias("expected"))
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """One row per document: ``doc`` (all its columns as a struct), size, source_size, target, copies.

    docs needs doc_id, text, source; other columns ride along in ``doc`` and can't clash. A null text has size 0 and a
    null source is a source of its own, last in order. Documents of size 0 are part of their source's line and add no
    words. Repeated rows are documents of their own; ties in (size, doc_id) are interchangeable. An empty table gives an
    empty result; where all sizes are 0 every target is 0. The offset derives from seed and source, so reruns agree.
    """
    n_buckets = max(16, docs.count() // PER_BUCKET)
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    bucket = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(n_buckets))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"), word_count(F.col("text")).alias("size"), bucket.alias("bucket"))
    cells = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    levels = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    per_source = targets(levels.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights, most)
    before = lambda *by: Window.partitionBy("key", *by).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("key", "size", F.coalesce(F.sum("n").over(before().orderBy("size")), F.lit(0)).alias("level_rank"))
    cells = cells.select("key", "size", "bucket", F.coalesce(F.sum("n").over(before("size").orderBy("bucket")), F.lit(0)).alias("cell_rank"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    placed = cells.join(levels, ["key", "size"]).join(per_source.withColumn("offset", offset), "key")
    within = Window.partitionBy("key", "size", "bucket").orderBy(F.col("doc.doc_id"))
    rank = F.col("level_rank") + F.col("cell_rank") + F.col("in_cell")
    return (
        rows.withColumn("in_cell", F.row_number().over(within))
        .join(placed, ["key", "size", "bucket"])
        .select("doc", "size", "source_size", "target", (F.floor(rank * F.col("expected") + F.col("offset")) - F.floor((rank - 1) * F.col("expected") + F.col("offset"))).alias("copies"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: the documents' own columns, one row per copy taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         ((coalesce(doc_id, 0) % b) + b) % b AS bucket
  FROM documents, (SELECT greatest(16, count(*) // {PER_BUCKET}) AS b FROM documents)
), s AS (SELECT key, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY key
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s
), r AS (SELECT *, 3.0::DOUBLE * words / weight AS reach FROM w
), l AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(3.0::DOUBLE * words) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM r WINDOW o AS (ORDER BY reach, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT reach AS f_reach, key AS f_key, level AS f_level FROM l WHERE level <= reach ORDER BY reach, key LIMIT 1
), t AS (
  SELECT key, words, CASE WHEN reach < f_reach OR (reach = f_reach AND key < f_key) THEN 3.0::DOUBLE * words ELSE least(3.0::DOUBLE * words, f_level * weight) END AS target,
         ('0x' || substr(md5('7:' || key), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM l, f
), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, bucket, doc_id) AS rank FROM d)
SELECT doc_id, size, words AS source_size, target,
       CAST((floor(rank * e + u) - floor((rank - 1) * e + u)) * size AS BIGINT) AS taken
FROM (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0.0 END AS e FROM k JOIN t USING (key))
"""
