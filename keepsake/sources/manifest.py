"""Provider manifests: paged file listings of cloud drives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegeo import iso_text, timestamp_error

KIND = "google_drive"
# Image types taken from a listing.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif")

PAGE_SCHEMA = (
    "nextPageToken string, files array<struct<id string, name string, mimeType string, size string, "
    "md5Checksum string, modifiedTime string, createdTime string, version string, "
    "parents array<string>, trashed boolean>>"
)


def manifest_error() -> Column:
    """First reason why a listed file cannot be taken (columns of an exploded file)."""
    size = F.col("size")
    return (
        F.when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "invalid:id")
        .when(F.coalesce("name", F.lit("")) == "", "invalid:name")
        .when(F.coalesce("trashed", F.lit(False)), "trashed")
        .when(size.isNotNull() & ~size.rlike(r"^\s*[+]?\d+\s*$"), "invalid:size")
        .when(size.isNotNull() & F.trim(size).try_cast("long").isNull(), "invalid:size")
        .otherwise(F.coalesce(
            timestamp_error(F.col("modifiedTime"), "modifiedTime", required=True),
            timestamp_error(F.col("createdTime"), "createdTime", required=False),
            F.when(F.exists(F.col("parents"), lambda parent: parent.isNull()), "invalid:parents"),
        ))
    )


def manifest_photos(pages: DataFrame, namespace: str, strict: bool = False) -> DataFrame:
    """Descriptors of the image files of listing pages, with an ``error`` for bad ones.

    Other file types are skipped. The provider's MD5 is metadata, never the content
    hash. Strict listings fail on the first bad image instead.
    """
    files = pages.select(F.inline("files")).filter(F.col("mimeType").isin(*IMAGE_TYPES))
    checked = files.withColumn("error", manifest_error())
    if strict:
        checked = checked.withColumn("error", F.when(
            F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad manifest entry: "), "error")).cast("string")
        ))
    good = F.col("error").isNull()
    escape = lambda text: F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    provider = F.to_json(F.struct(
        iso_text(F.col("createdTime")).alias("drive_created_time"),
        F.col("id").alias("drive_file_id"),
        F.col("md5Checksum").alias("drive_md5_checksum"),
        iso_text(F.col("modifiedTime")).alias("drive_modified_time"),
        F.coalesce("parents", F.array().cast("array<string>")).alias("drive_parents"),
        F.col("version").alias("drive_version"),
        F.lit(KIND).alias("provider"),
    ), {"ignoreNullFields": "false"})
    return checked.select(
        F.concat(F.lit(f"{namespace}:"), "id").alias("source_id"),
        F.lit(KIND).alias("source_kind"), "name", F.col("mimeType").alias("mime_type"),
        F.when(good, F.trim("size").try_cast("long")).alias("byte_size"),
        F.when(good, iso_text(F.col("modifiedTime"))).alias("modified_at"),
        F.when(good, F.concat(F.lit("gdrive://"), escape(F.lit(namespace)), F.lit("/files/"), escape(F.col("id")))).alias("raw_uri"),
        F.lit(None).cast("string").alias("content_hash"),
        F.when(good, provider).alias("metadata_json"),
        "error",
    )


def page_problems(pages: DataFrame) -> DataFrame:
    """Next-page tokens that are empty or occur more than once."""
    tokens = pages.filter(F.col("nextPageToken").isNotNull()).groupBy("nextPageToken").agg(F.count("*").alias("n_pages"))
    problem = F.when(F.col("nextPageToken") == "", "invalid").when(F.col("n_pages") > 1, "repeated")
    return tokens.withColumn("problem", problem).filter("problem IS NOT NULL")


def sample_photos(photos: DataFrame, limit: int) -> DataFrame:
    """A fixed sample: JPEG first, then by id."""
    return photos.orderBy(F.col("mime_type") != "image/jpeg", "source_id").limit(limit)


def descriptor_error() -> Column:
    """Reason why a descriptor is no valid source photo."""
    missing = F.lit(False)
    for name in ("source_id", "source_kind", "name", "raw_uri"):
        missing = missing | (F.coalesce(name, F.lit("")) == "")
    return (
        F.when(missing, "identity_missing")
        .when(F.col("byte_size") < 0, "negative_size")
        .otherwise(timestamp_error(F.col("modified_at"), "modified_at", required=True))
    )
