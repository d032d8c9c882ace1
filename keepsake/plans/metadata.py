"""Metadata into an archive: extractions, diagnostics and the times that follow, at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metadata import backfill_times, backfill_versions, metadata_diagnostics, metadata_targets, project_metadata
from ..session import materialise
from ..sources.snapshots import Snapshot, SnapshotLog


def import_metadata(normalised: DataFrame, log: SnapshotLog, at: str, label: str | None = None) -> Snapshot:
    """Project normalised tag or track records (by ``object_id``) onto the objects of an archive.

    Objects that were extracted from their present content already are left alone, so the same
    records again change nothing. Times read go to objects that have none, and to the version
    of the content they were read from. All tables change in one snapshot.
    """
    base = log.current()
    objects = log.read("objects", base)
    targets = metadata_targets(objects, log.read("attachments", base)).select("object_id", "blob_id", "content_hash", "occurred_at")
    rows = materialise(project_metadata(targets, normalised, log.read("metadata_extractions", base)), "extractions")
    told = rows.filter("backfill")
    # Objects lie by their natural key, which the extractions do not know.
    owners = objects.join(told.select("object_id").distinct(), "object_id", "left_semi")
    near = {"objects": log.touched("objects", owners), "object_versions": log.touched("object_versions", told)}
    replaced = {
        "objects": (near["objects"], log.stage("objects", backfill_times(log.read("objects", base, near["objects"]), rows))),
        "object_versions": (near["object_versions"], log.stage("object_versions", backfill_versions(log.read("object_versions", base, near["object_versions"]), rows))),
    }
    dated = lambda df, name: df.withColumn(name, F.lit(at))
    appended = {
        "metadata_extractions": log.stage("metadata_extractions", dated(rows, "extracted_at")),
        "metadata_diagnostics": log.stage("metadata_diagnostics", dated(metadata_diagnostics(rows), "created_at")),
    }
    return log.commit(base, replaced, appended, label=label)
