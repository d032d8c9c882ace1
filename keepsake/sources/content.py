"""Binary content and its digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegeo import uri_to_path


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files with path, size, time and content, one row each (2 GB at most)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )


def digest(items: DataFrame) -> DataFrame:
    """Add ``sha256`` and ``byte_size`` of inline ``content``."""
    return items.withColumn("sha256", F.sha2("content", 256)).withColumn("byte_size", F.octet_length("content").cast("long"))


def content_digest(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Digest of inline content, else of the file the URI names.

    ``files`` has ``path`` (local, as in the URI) and ``content``. Items with neither
    get an error instead of a digest.
    """
    path = uri_to_path(F.col("raw_uri"))
    keyed = items.withColumn("_path", path)
    if files is not None:
        found = digest(files.select(F.col("path").alias("_path"), "content")).select(
            "_path", F.col("sha256").alias("_file_sha"), F.col("byte_size").alias("_file_size")
        )
        # Items that bring their content do not take part in the join.
        looked_up = F.when(F.col("content").isNull(), F.col("_path"))
        keyed = keyed.withColumn("_path", looked_up).join(found, "_path", "left")
    else:
        keyed = keyed.withColumn("_file_sha", F.lit(None).cast("string")).withColumn("_file_size", F.lit(None).cast("long"))
    inline = F.col("content").isNotNull()
    error = (
        F.when(inline, F.lit(None).cast("string"))
        .when(path.isNull(), "content is required when raw_uri is not a file URI")
        .when(F.col("_file_sha").isNull(), "file not found")
    )
    return keyed.select(
        *items.columns,
        F.when(inline, F.sha2("content", 256)).otherwise(F.col("_file_sha")).alias("sha256"),
        F.when(inline, F.octet_length("content").cast("long")).otherwise(F.col("_file_size")).alias("byte_size"),
        error.alias("error"),
    )


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Compare announced size and hash of each entry with the content that arrived."""
    joined = manifest.select("source_id", F.col("byte_size").alias("expected_size"), F.col("content_hash").alias("expected_hash")).join(
        digests.select("source_id", "byte_size", "sha256"), "source_id", "left"
    )
    problem = (
        F.when(~F.col("expected_hash").rlike("(?i)^[0-9a-f]{64}$"), "unsupported_hash_format")
        .when(F.col("sha256").isNull(), "content_missing")
        .when(F.col("byte_size") != F.col("expected_size"), "byte_size_mismatch")
        .when(F.lower("expected_hash") != F.col("sha256"), "content_hash_mismatch")
        .otherwise("ok")
    )
    return joined.select("source_id", "byte_size", problem.alias("verdict"))
