"""Photo folders: top level only, nothing but JPEG files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "local_folder"


def _resolved_inside(root: str):
    """Local files whose path, links followed, is still below the folder; links themselves may be there."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = os.path.join(os.path.realpath(root), "")
        for frame in frames:
            local = frame["path"].str.replace("^file:/+", "/", regex=True)
            yield frame[[os.path.realpath(path).startswith(base) for path in local]]

    return keep


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime`` of the files in a folder, content not read.

    Links of a local folder that lead out of it are left out; other stores have none. Paths
    alone are looked at, where the files are.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
        .select("path", "length", "modificationTime")
    )
    root = folder.removeprefix("file://") if folder.startswith(("/", "file:///")) else None
    return files if root is None else files.mapInPandas(_resolved_inside(root), files.schema)


def list_photos(files: DataFrame, root: str, namespace: str) -> DataFrame:
    """Descriptors of the JPEG files directly below ``root``, in listing order.

    Sorted ignoring case, then by exact name. Files that resolve outside of the root do
    not carry its prefix and are left out.
    """
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(_path, {len(base) + 1})")
    inside = files.withColumn("_path", path).filter(F.col("_path").startswith(base)).withColumn("relative_path", relative)
    photos = inside.filter(~F.col("relative_path").contains("/") & F.lower("relative_path").rlike(r"[^/]\.jpe?g$"))
    escaped = F.replace(F.replace(F.url_encode("relative_path"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return photos.select(
        F.concat(F.lit(f"{namespace}:"), "relative_path").alias("source_id"),
        F.lit(KIND).alias("source_kind"),
        F.col("relative_path").alias("name"),
        F.lit("image/jpeg").alias("mime_type"),
        F.col("length").alias("byte_size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("modified_at"),
        F.concat(F.lit("file://" + base), escaped).alias("raw_uri"),
        F.lit(None).cast("string").alias("content_hash"),
    ).orderBy(F.lower("name"), "name")
