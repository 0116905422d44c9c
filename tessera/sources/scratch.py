"""Tables that a query makes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under one of our own where that is unset (local mode)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete path when it ends, whether or not the session was stopped before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    try:
        df.write.parquet(path)
    finally:
        removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
