"""A rank over a whole table without a task that holds it: range partitions, ranks within, offsets of the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables


def total_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with ``rank`` from 1 in that order, which must be total. The only window over all is of a row per partition."""
    dealt = rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_pid").count().select("_pid", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    return within.join(sizes, "_pid").withColumn("rank", (F.col("_n") + F.col("_before")).cast("int")).drop("_pid", "_n", "_before")


def ranked(rows: DataFrame, by: str, order: list[Column], tables: Tables) -> DataFrame:
    """rows with ``rank`` from 1 within each value of ``by``, in that order, which must be total. Values are few or many, large or
    small: ranges are of all rows, and are written, so that ranks and offsets see the same ones."""
    dealt = tables.save(rows.repartitionByRange(F.col(by), *order).withColumn("_pid", F.spark_partition_id()))
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_pid", by).orderBy(*order)))
    upto = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_pid", by).count().select("_pid", by, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    return within.join(sizes, ["_pid", by]).withColumn("rank", (F.col("_n") + F.col("_before")).cast("int")).drop("_pid", "_n", "_before")
