"""Deterministic identities as native column expressions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = "0123456789abcdef"
# RFC 4122 variant: the two top bits of the nibble become 10.
VARIANT_DIGITS = "89ab89ab89ab89ab"


def uuid5_hex(namespace: uuid.UUID, name: Column) -> Column:
    """UUIDv5 of ``name`` as 32 hex characters."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    return F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        F.translate(F.substring(digest, 17, 1), HEX_DIGITS, VARIANT_DIGITS),
        F.substring(digest, 18, 15),
    )


def _present(*columns: Column) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & column.isNotNull() & (column != "")
    return condition


@dataclass(frozen=True)
class IdSpace:
    """Namespace and prefixes; an archive keeps one for its whole life."""

    namespace: uuid.UUID = uuid.UUID("6f1d0a52-c3b8-4e0f-9d5a-7be1f2037c44")
    prefix: str = "kps"
    ref_scheme: str = "keepsake://object/"

    def _id(self, kind: str, name: Column) -> Column:
        return F.concat(F.lit(f"{self.prefix}_{kind}_"), uuid5_hex(self.namespace, name))

    def object_id(self, source: Column, source_id: Column) -> Column:
        """Null when either part is missing: such a row has no identity."""
        name = F.concat_ws(":", F.lit("object"), source, source_id)
        return F.when(_present(source, source_id), self._id("obj", name))

    def relation_id(self, relation_type: Column, source: Column, target: Column) -> Column:
        return self._id("rel", F.concat_ws(":", F.lit("relation"), relation_type, source, target))

    def blob_id(self, content_hash: Column) -> Column:
        return F.when(
            content_hash.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(f"{self.prefix}_blob_"), content_hash)
        )

    def location_id(self, object_id: Column, raw_uri: Column) -> Column:
        name = F.concat_ws(":", F.lit("location"), object_id, raw_uri)
        return F.when(_present(object_id, raw_uri), self._id("loc", name))

    def extraction_id(self, object_id: Column, blob_id: Column, extractor_id: Column) -> Column:
        return self._id("meta", F.concat_ws(":", F.lit("metadata"), object_id, blob_id, extractor_id))

    def result_id(
        self, object_id: Column, name: Column, version: Column, semantic_type: Column,
        content_hash: Column, blob_id: Column,
    ) -> Column:
        parts = (object_id, name, version, semantic_type, content_hash, F.coalesce(blob_id, F.lit("")))
        return self._id("sem", F.concat_ws(":", F.lit("semantic"), *parts))

    def semantic_relation_id(self, result_id: Column, relation_type: Column, target: Column) -> Column:
        name = F.concat_ws(":", F.lit("semantic-relation"), result_id, relation_type, target)
        return self._id("semrel", name)

    def is_object_id(self, value: Column) -> Column:
        return F.coalesce(value.rlike(f"^{self.prefix}_obj_[0-9a-f]{{32}}$"), F.lit(False))

    def safe_ref(self, object_id: Column) -> Column:
        """Opaque reference that says nothing about where the content lies."""
        return F.concat(F.lit(self.ref_scheme), object_id)


DEFAULT_IDS = IdSpace()


def canonical_json_hash(json_text: Column) -> Column:
    """SHA-256 of the parsed document: key order and spacing do not matter.

    Numbers are spelled the way VARIANT spells them (``1.0`` as ``1``), so hashes are
    stable within an archive but not comparable with those of other tools. Documents
    that do not parse (duplicate keys included) are hashed as text.
    """
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text), 256)


def canonical_json(*columns: Column) -> Column:
    """JSON object text with null fields kept; pass the columns sorted by name."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def identity_hint(value: Column, length: int = 12) -> Column:
    """Short one-way pseudonym (12 characters for sources, 24 for principals)."""
    return F.substring(F.sha2(value, 256), 1, length)
