"""Ingest of source objects in batches: identity, outcome, versions, blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import OBJECT_TYPES
from ..functions.ids import DEFAULT_IDS, IdSpace
from ..operators.upsert import (
    BINARY_TYPES, append_versions, apply_outcomes, attachment_rows, blob_rows, classify,
    delivery_fingerprint, location_rows, refresh_versions,
)
from ..session import materialise

DESCRIPTIVE = ["object_type", "occurred_at", "captured_at", "raw_uri", "mime_type", "metadata_json"]


def reject_reason() -> Column:
    """Why an item cannot be ingested, else null."""
    kind = F.schema_of_variant(F.try_parse_json(F.coalesce("metadata_json", F.lit("{}"))))
    return (
        F.when(~F.coalesce(F.col("object_type").isin(*OBJECT_TYPES), F.lit(False)), "unsupported_object_type")
        .when((F.coalesce("source", F.lit("")) == "") | (F.coalesce("raw_uri", F.lit("")) == ""), "source_and_raw_uri_required")
        .when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "metadata_not_an_object")
    )


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid items, and rejected ones with ``reason``."""
    judged = items.withColumn("reason", reject_reason())
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def identify(items: DataFrame, ids: IdSpace = DEFAULT_IDS) -> DataFrame:
    """Give valid items identity, canonical metadata, digest and comparison value.

    Items carry ``ordinal`` and either ``content`` or ``content_hash, byte_size``.
    """
    if "content_hash" not in items.columns:
        items = items.withColumn("content_hash", F.sha2("content", 256)).withColumn(
            "byte_size", F.octet_length("content").cast("long")
        )
    source_id = F.when(F.coalesce("source_id", F.lit("")) == "", F.col("raw_uri")).otherwise(F.col("source_id"))
    canonical = F.to_json(F.try_parse_json(F.coalesce("metadata_json", F.lit("{}"))))
    named = items.withColumn("source_id", source_id).withColumn("metadata_json", canonical)
    named = named.withColumn("object_id", ids.object_id(F.col("source"), F.col("source_id")))
    blob = F.when(F.col("object_type").isin(*BINARY_TYPES), ids.blob_id(F.col("content_hash")))
    return named.withColumn("blob_id", blob).withColumn("fingerprint", delivery_fingerprint()).drop("content")


@dataclass(frozen=True)
class IngestResult:
    outcomes: DataFrame
    objects: DataFrame
    new_versions: DataFrame
    blobs: DataFrame
    attachments: DataFrame
    locations: DataFrame


def ingest(items: DataFrame, objects: DataFrame, versions: DataFrame, ids: IdSpace = DEFAULT_IDS, **hot) -> IngestResult:
    """Merge a batch of valid items into the stored tables.

    Identified rows are written once, so content is read and hashed once; outcomes are
    written because all the other tables come from them.
    """
    return ingest_identified(materialise(identify(items, ids), "deliveries"), objects, versions, ids, **hot)


def ingest_identified(incoming: DataFrame, objects: DataFrame, versions: DataFrame, ids: IdSpace = DEFAULT_IDS, **hot) -> IngestResult:
    """``ingest`` of rows that ``identify`` has given their identity, read several times."""
    known = objects.withColumn("fingerprint", delivery_fingerprint())
    outcomes = materialise(classify(incoming, known, **hot), "outcomes")
    written = outcomes.withColumn("parent_id", F.lit(None).cast("string")).withColumn(
        "topic", F.lit(None).cast("string")
    ).withColumn("created_at", F.col("captured_at"))
    return IngestResult(
        outcomes=outcomes,
        objects=apply_outcomes(objects, written),
        new_versions=append_versions(versions, written, **hot),
        blobs=blob_rows(outcomes),
        attachments=attachment_rows(outcomes),
        locations=location_rows(outcomes, ids),
    )


def refreshed_versions(versions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stored versions with the descriptive columns of deliveries that changed them."""
    columns = [name for name in DESCRIPTIVE if name in versions.columns]
    return refresh_versions(versions, outcomes, columns)


def import_outcomes(listing: DataFrame, outcomes: DataFrame, rollup: DataFrame) -> DataFrame:
    """One outcome per listed item: a bad item carries its error, the others go on.

    ``listing`` has ``source_kind, source_id, name, error``; ``outcomes`` the ingest
    outcomes; ``rollup`` the status of the extractors per object. Where the listing has
    ``ordinal``, an item may be listed more than once.
    """
    key = ["source_kind", "source_id", *(["ordinal"] if "ordinal" in listing.columns else [])]
    ingested = outcomes.withColumnRenamed("source", "source_kind").select(
        *key, "object_id", F.col("outcome").alias("ingestion_outcome")
    )
    joined = listing.join(ingested, key, "left").join(
        rollup.select("object_id", "semantic_status"), "object_id", "left"
    )
    conflict = F.col("ingestion_outcome") == "conflict"
    error = F.coalesce(
        "error",
        F.when(conflict, "identity_conflict"),
        F.when(F.col("object_id").isNull(), "not_ingested"),
    )
    failed = error.isNotNull()
    return joined.select(
        F.col("name").alias("filename"), "source_id",
        F.when(~failed, F.col("object_id")).alias("object_id"),
        F.when(~failed, F.col("ingestion_outcome")).alias("ingestion_outcome"),
        F.when(~failed, F.col("semantic_status")).alias("semantic_status"),
        error.alias("error"),
    )


def batch_totals(outcomes: DataFrame) -> DataFrame:
    """Succeeded and failed items of an import."""
    failed = F.col("error").isNotNull() | (F.coalesce("semantic_status", F.lit("")) == "failed")
    return outcomes.agg(
        F.count("*").alias("n_items"), F.count_if(~failed).alias("n_succeeded"), F.count_if(failed).alias("n_failed")
    )
