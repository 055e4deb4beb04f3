"""The event queue's state machine, shared by batch and streaming.

An event's last status, attempts and time decide what happens to it: PENDING is claimed, a PROCESSING lease that has run
out is retried with exponential backoff, and one that has used up its attempts fails for good.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import delete, shared_dir

# Fixed values.
LEASE_S, BASE_S, CAP_S, MAX_ATTEMPTS = 30, 2.0, 300.0, 5


def next_action(status: Column, attempts: Column, age_s: Column) -> Column:
    wait = F.least(F.lit(CAP_S), F.lit(BASE_S) * F.pow(F.lit(2.0), attempts - 1))
    expired = (status == "PROCESSING") & (age_s > LEASE_S)
    return (
        F.when(status.isin("PROCESSED", "FAILED"), "NONE")
        .when((status == "PENDING") & ((attempts == 0) | (age_s >= wait)), "CLAIM")
        .when(expired & (attempts >= MAX_ATTEMPTS), "FAIL")
        .when(expired, "RETRY")
        .otherwise("WAIT")
    )


def latest(events: DataFrame) -> DataFrame:
    """Idempotent consumption: one row per event id, a duplicate delivery changes nothing."""
    return events.dropDuplicates(["event_id"])


def status_counts(events: DataFrame) -> DataFrame:
    """Works on a stream (update or complete mode) and on a batch alike."""
    return events.groupBy("status").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, keys: list[str], root: str | None = None) -> DataFrame:
    """Drains what a stream has now and returns the last row of each key.

    Updates go to Parquet, a folder per batch, written anew if the batch is repeated; so does the checkpoint. Both are in
    ``root``, a folder that the caller names: a query that is started again with it goes on where it stood. Without one,
    the drain is one of its own in the shared folder, which goes with the process. Nothing is kept on the driver.
    """
    spark = stream.sparkSession
    if root is None:
        root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        atexit.register(_removed, spark, root)

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{root}/out/*")
    rest = [x for x in stream.columns if x not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")


def _removed(spark, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the session may be gone already
        pass
