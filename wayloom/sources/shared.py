"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the checkpoint folder that is set. Where neither is: a temporary folder in local mode, a
    folder of the warehouse on a cluster, whose nodes share that."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    root = tempfile.mkdtemp(prefix="wayloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_wayloom"
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables that cut lineage; ``drop`` removes one early, ``close`` all, the end of the process what is left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._wayloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._wayloom_path)

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may be gone already
            pass


Save = Callable[[DataFrame], DataFrame]
