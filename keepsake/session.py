"""Session settings every job relies on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-changeable SQL settings. Skewed joins are split even when that costs an
# extra shuffle, because one object, source or hash may hold a third of all rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Texts may be long: fewer of them per Arrow batch keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Of keys that repeat in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # What is written holds texts, more than once: half the bytes of the default codec.
    "spark.sql.parquet.compression.codec": "zstd",
    # Shuffle files go when their query ends; what later steps need is in written tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory below the checkpoint folder all executors can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table, which survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    table = spark.read.parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
