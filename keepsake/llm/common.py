"""Small helpers the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# The six ASCII characters between words, and a regular expression for runs of them.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"


def result_texts(results: DataFrame) -> DataFrame:
    """The two columns of ``semantic_results`` that text operators read; others are left behind."""
    return results.select("object_id", F.col("result_text").cast("string").alias("result_text"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Words in order, unchanged; none for null, empty or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


# Bits of a bitmap of keys: 8 MB.
BITMAP_BITS = 1 << 26


def likely_among(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of ``rows``: none that is, few others.

    A bitmap of hashes, of one size for any number of keys, goes to all tasks, so that a
    join that follows shuffles few rows of ``df`` in vain.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    # Bucket numbers count from 1.
    bucket = F.bitmap_bucket_number(place + 1)
    bitmap = rows.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("_bits"))
    at = F.bitmap_bit_position(place + 1)
    byte = F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))
    held = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(7).cast("int"))) != 0
    marked = df.withColumn("_bucket", bucket).join(F.broadcast(bitmap), "_bucket")
    return marked.filter(held).select(*df.columns)


class Scratch:
    """Intermediate tables of one run, below the folder that all executors share.

    ``write`` cuts lineage: what it returns is read from the table, so a lost executor
    costs at most the tasks it was running. ``drop`` removes tables that nothing reads
    any more; the last tables stay, because the lazy result still reads them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_dir(spark, label)

    def write(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(**(options or {})).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
