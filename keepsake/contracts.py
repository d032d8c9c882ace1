"""Table contracts: columns, keys, references and value rules of the archive index."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA_VERSION = 5

# Enumerations the tables accept.
IMPORT_STATUS = ("running", "complete", "failed")
SEVERITIES = ("warning", "error")
METADATA_STATUS = ("complete", "partial", "failed")
RESULT_STATUS = ("complete", "partial", "unsupported", "failed")
TIME_CONFIDENCE = ("high", "none")
RELATION_TYPES = (
    "object_has_semantic_result", "semantic_mentions_entity", "semantic_mentions_place",
    "semantic_mentions_person", "semantic_mentions_topic",
)
EVIDENCE_KINDS = ("time", "gps", "visual_similarity", "person", "text_context", "temporal_neighbor")
OBJECT_TYPES = ("photo", "video", "audio", "note", "message")
AUDIT_COLUMNS = (
    "timestamp", "request_id", "endpoint", "http_status", "latency_ms", "result_count", "principal_hash",
)


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(value) for value in values)})"


def unit_range(column: str) -> str:
    return f"({column} IS NULL OR ({column} >= 0.0 AND {column} <= 1.0))"


@dataclass(frozen=True)
class Table:
    """``schema`` is DDL; ``required`` columns are never null; ``defaults`` fill added ones."""

    schema: str
    unique: tuple[tuple[str, ...], ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


TABLES: dict[str, Table] = {
    "objects": Table(
        "object_id string, object_type string, source string, source_id string, occurred_at string, "
        "captured_at string, parent_id string, raw_uri string, content_hash string, mime_type string, "
        "topic string, event_id string, confidence double, metadata_json string, created_at string",
        unique=(("object_id",), ("source", "source_id")),
        references={"parent_id": ("objects", "object_id")},
        required=("object_id", "object_type", "raw_uri", "metadata_json", "created_at"),
        defaults={"metadata_json": "{}"},
    ),
    "relations": Table(
        "relation_id string, from_object_id string, to_object_id string, relation_type string, "
        "confidence double, model_id string, created_at string",
        unique=(("relation_id",),),
        references={"from_object_id": ("objects", "object_id"), "to_object_id": ("objects", "object_id")},
        required=("relation_id", "from_object_id", "to_object_id", "relation_type", "created_at"),
    ),
    "import_runs": Table(
        "import_id string, source string, raw_uri string, source_hash string, started_at string, "
        "completed_at string, status string, stats_json string, error string",
        unique=(("import_id",),),
        required=("import_id", "source", "raw_uri", "source_hash", "started_at", "status"),
        checks={"status": one_of("status", IMPORT_STATUS)},
    ),
    "object_versions": Table(
        "object_id string, version bigint, import_id string, object_type string, occurred_at string, "
        "captured_at string, parent_id string, raw_uri string, content_hash string, mime_type string, "
        "topic string, metadata_json string, created_at string",
        unique=(("object_id", "version"), ("object_id", "content_hash")),
        references={
            "object_id": ("objects", "object_id"), "import_id": ("import_runs", "import_id"),
            "parent_id": ("objects", "object_id"),
        },
        required=("object_id", "version", "import_id", "content_hash", "metadata_json"),
        defaults={"metadata_json": "{}"},
    ),
    "import_diagnostics": Table(
        "import_id string, severity string, code string, source_id string, detail string, created_at string",
        unique=(),
        references={"import_id": ("import_runs", "import_id")},
        required=("import_id", "severity", "code", "detail"),
        checks={"severity": one_of("severity", SEVERITIES)},
    ),
    "blobs": Table(
        "blob_id string, sha256 string, byte_size bigint, mime_type string, created_at string",
        unique=(("blob_id",), ("sha256",)),
        required=("blob_id", "sha256", "byte_size", "created_at"),
        checks={"byte_size": "byte_size >= 0"},
    ),
    "attachments": Table(
        "object_id string, blob_id string, created_at string",
        unique=(("object_id",),),
        references={"object_id": ("objects", "object_id"), "blob_id": ("blobs", "blob_id")},
        required=("object_id", "blob_id"),
    ),
    "blob_locations": Table(
        "location_id string, object_id string, blob_id string, raw_uri string, created_at string",
        unique=(("location_id",), ("object_id", "raw_uri")),
        references={"object_id": ("objects", "object_id"), "blob_id": ("blobs", "blob_id")},
        required=("location_id", "object_id", "blob_id", "raw_uri"),
    ),
    "metadata_extractions": Table(
        "extraction_id string, object_id string, blob_id string, extractor_id string, status string, "
        "metadata_json string, occurred_at string, occurred_at_source string, occurred_at_confidence string, "
        "extracted_at string",
        unique=(("extraction_id",), ("object_id", "blob_id", "extractor_id")),
        references={"object_id": ("objects", "object_id"), "blob_id": ("blobs", "blob_id")},
        required=("extraction_id", "object_id", "blob_id", "extractor_id", "status", "metadata_json"),
        checks={
            "status": one_of("status", METADATA_STATUS),
            "occurred_at_confidence": one_of("occurred_at_confidence", TIME_CONFIDENCE),
        },
    ),
    "metadata_diagnostics": Table(
        "extraction_id string, severity string, code string, detail string, created_at string",
        unique=(("extraction_id", "code", "detail"),),
        references={"extraction_id": ("metadata_extractions", "extraction_id")},
        required=("extraction_id", "severity", "code", "detail"),
        checks={"severity": one_of("severity", SEVERITIES)},
    ),
    "semantic_results": Table(
        "semantic_result_id string, object_id string, source_blob_id string, source_content_hash string, "
        "extractor_name string, extractor_version string, semantic_type string, status string, "
        "confidence double, result_json string, result_text string, diagnostics_json string, "
        "provenance_json string, is_current boolean, created_at string",
        unique=(
            ("semantic_result_id",),
            ("object_id", "extractor_name", "extractor_version", "semantic_type", "source_content_hash", "source_blob_id"),
        ),
        references={"object_id": ("objects", "object_id"), "source_blob_id": ("blobs", "blob_id")},
        required=("semantic_result_id", "object_id", "extractor_name", "status", "is_current"),
        checks={"status": one_of("status", RESULT_STATUS), "confidence": unit_range("confidence")},
        defaults={"diagnostics_json": "[]", "is_current": "true"},
    ),
    "semantic_relations": Table(
        "semantic_relation_id string, object_id string, semantic_result_id string, relation_type string, "
        "target_ref string, confidence double, created_at string",
        unique=(("semantic_relation_id",), ("semantic_result_id", "relation_type", "target_ref")),
        references={
            "object_id": ("objects", "object_id"), "semantic_result_id": ("semantic_results", "semantic_result_id"),
        },
        required=("semantic_relation_id", "object_id", "semantic_result_id", "relation_type", "target_ref"),
        checks={"relation_type": one_of("relation_type", RELATION_TYPES), "confidence": unit_range("confidence")},
        defaults={"target_ref": ""},
    ),
    "event_evidence": Table(
        "event_evidence_id string, object_id string, semantic_result_id string, evidence_type string, "
        "evidence_json string, confidence double, created_at string",
        unique=(("event_evidence_id",),),
        references={
            "object_id": ("objects", "object_id"), "semantic_result_id": ("semantic_results", "semantic_result_id"),
        },
        required=("event_evidence_id", "object_id", "evidence_type", "evidence_json"),
        checks={"evidence_type": one_of("evidence_type", EVIDENCE_KINDS), "confidence": unit_range("confidence")},
    ),
    "schema_migrations": Table(
        "version int, applied_at string", unique=(("version",),), required=("version", "applied_at"),
    ),
}
