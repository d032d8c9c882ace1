"""Merging deliveries into stored tables: outcomes, versions, blobs, parent edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_IDS, IdSpace
from .hotkeys import CHUNK_SPAN, HOT_ROWS, latest, ordered_lag, ordered_rank

NATURAL_KEY = ["source", "source_id"]
# Columns whose equality makes a full delivery "unchanged"; the capture time is not one.
DELIVERY_TUPLE = ["content_hash", "object_type", "raw_uri", "mime_type", "metadata_json", "occurred_at"]
OBJECT_COLUMNS = [
    "object_id", "object_type", "source", "source_id", "occurred_at", "captured_at", "parent_id",
    "raw_uri", "content_hash", "mime_type", "topic", "metadata_json", "created_at",
]


def delivery_fingerprint(columns: list[str] = DELIVERY_TUPLE) -> Column:
    """One comparable value for a tuple of columns, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def classify(
    incoming: DataFrame, stored: DataFrame, hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """Outcome of every delivered row, as if rows arrived one by one in ``ordinal`` order.

    Both sides carry ``source, source_id, object_id, fingerprint``. A key stored under
    another id is a conflict; a repeated fingerprint is unchanged; else the row inserts
    (unknown key) or changes (known key).
    """
    known = stored.select(
        *NATURAL_KEY,
        F.col("object_id").alias("stored_id"),
        F.col("fingerprint").alias("stored_fingerprint"),
    )
    ordered = ordered_lag(incoming, NATURAL_KEY, "ordinal", ["fingerprint"], hot_rows, chunk_span)
    joined = ordered.join(known, NATURAL_KEY, "left")
    before = F.when(F.col("has_prev"), F.col("prev_fingerprint")).otherwise(F.col("stored_fingerprint"))
    outcome = (
        F.when(F.col("stored_id") != F.col("object_id"), "conflict")
        .when(before.isNull(), "inserted")
        .when(before == F.col("fingerprint"), "unchanged")
        .otherwise("changed")
    )
    return joined.select(*incoming.columns, outcome.alias("outcome"))


def apply_outcomes(stored: DataFrame, outcomes: DataFrame, columns: list[str] = OBJECT_COLUMNS) -> DataFrame:
    """Next state of the table: per key the last row that inserted or changed it wins.

    The time of creation is that of the first row, stored or delivered.
    """
    written = outcomes.filter(F.col("outcome").isin("inserted", "changed"))
    payload = [name for name in columns if name not in NATURAL_KEY]
    winner = latest(written, NATURAL_KEY, F.col("ordinal"), payload)
    if "created_at" in columns:
        born = written.groupBy(*NATURAL_KEY).agg(F.min_by("created_at", "ordinal").alias("created_at"))
        winner = winner.drop("created_at").join(born, NATURAL_KEY)
    merged = stored.alias("s").join(winner.alias("w"), NATURAL_KEY, "full_outer")
    taken = F.col("w.object_id").isNotNull()
    kept_from_first = {"created_at"}

    def value(name: str) -> Column:
        if name in NATURAL_KEY:
            return F.col(name)
        if name in kept_from_first:
            return F.coalesce(F.col(f"s.{name}"), F.col(f"w.{name}")).alias(name)
        return F.when(taken, F.col(f"w.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    return merged.select(*[value(name) for name in columns])


def append_versions(
    stored_versions: DataFrame, outcomes: DataFrame, hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """New version rows: one per content hash not yet known for the object.

    Numbers continue after the highest stored one, in the order hashes first appear;
    going back to an earlier content adds none.
    """
    usable = outcomes.filter(F.col("outcome") != "conflict")
    payload = [name for name in usable.columns if name not in ("object_id", "content_hash", "ordinal")]
    row = F.struct("ordinal", *payload)
    first_seen = usable.groupBy("object_id", "content_hash").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by(row, F.col("ordinal")).alias("_row"),
    )
    known = stored_versions.select("object_id", "content_hash")
    fresh = first_seen.join(known, ["object_id", "content_hash"], "left_anti")
    fresh = fresh.select("object_id", "content_hash", "ordinal", *[F.col("_row")[name].alias(name) for name in payload])
    highest = stored_versions.groupBy("object_id").agg(F.max("version").alias("_highest"))
    ranked = ordered_rank(fresh, ["object_id"], "ordinal", "_nth", hot_rows, chunk_span)
    numbered = ranked.join(highest, "object_id", "left")
    version = F.coalesce(F.col("_highest"), F.lit(0)).cast("long") + F.col("_nth")
    return numbered.withColumn("version", version).drop("_highest", "_nth")


def refresh_versions(stored_versions: DataFrame, outcomes: DataFrame, columns: list[str]) -> DataFrame:
    """Descriptive columns of a known version follow the last delivery that changed it."""
    changed = outcomes.filter(F.col("outcome") == "changed")
    key = ["object_id", "content_hash"]
    newest = latest(changed, key, F.col("ordinal"), columns)
    joined = stored_versions.alias("v").join(newest.alias("n").withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    selected = [
        F.when(hit, F.col(f"n.{name}")).otherwise(F.col(f"v.{name}")).alias(name)
        if name in columns else F.col(name if name in key else f"v.{name}")
        for name in stored_versions.columns
    ]
    return joined.select(*selected, hit.alias("refreshed"))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored, each key once (lowest row wins)."""
    payload = [name for name in incoming.columns if name not in keys]
    row = F.min(F.struct(*payload)).alias("_row") if payload else F.count("*").alias("_n")
    once = incoming.groupBy(*keys).agg(row)
    fresh = once.join(stored.select(*keys), keys, "left_anti")
    return fresh.select(*keys, *[F.col("_row")[name].alias(name) for name in payload])


BINARY_TYPES = ("photo", "video", "audio")


def blob_rows(outcomes: DataFrame) -> DataFrame:
    """One blob per distinct content of binary objects; the first delivery describes it."""
    binary = outcomes.filter(F.col("object_type").isin(*BINARY_TYPES) & (F.col("outcome") != "conflict"))
    first = binary.groupBy("content_hash").agg(
        F.min_by(F.struct("byte_size", "mime_type", "captured_at"), F.col("ordinal")).alias("_row")
    )
    return first.select(
        DEFAULT_IDS.blob_id(F.col("content_hash")).alias("blob_id"),
        F.col("content_hash").alias("sha256"),
        F.col("_row.byte_size").alias("byte_size"),
        F.col("_row.mime_type").alias("mime_type"),
        F.col("_row.captured_at").alias("created_at"),
    )


def attachment_rows(outcomes: DataFrame) -> DataFrame:
    """The blob an object has now: that of its last binary delivery."""
    binary = outcomes.filter(F.col("object_type").isin(*BINARY_TYPES) & (F.col("outcome") != "conflict"))
    last = latest(binary, ["object_id"], F.col("ordinal"), ["content_hash"])
    return last.select("object_id", DEFAULT_IDS.blob_id(F.col("content_hash")).alias("blob_id"))


def location_rows(outcomes: DataFrame, ids: IdSpace = DEFAULT_IDS) -> DataFrame:
    """Every place an object was delivered from, with the blob last seen there."""
    binary = outcomes.filter(F.col("object_type").isin(*BINARY_TYPES) & (F.col("outcome") != "conflict"))
    last = latest(binary, ["object_id", "raw_uri"], F.col("ordinal"), ["content_hash"])
    return last.select(
        ids.location_id(F.col("object_id"), F.col("raw_uri")).alias("location_id"),
        "object_id", "raw_uri",
        ids.blob_id(F.col("content_hash")).alias("blob_id"),
    )


def duplicate_blobs(locations: DataFrame) -> DataFrame:
    """Content held by more than one object, as counts: members are never collected."""
    pairs = locations.groupBy("blob_id", "object_id").agg(F.count("*").alias("n_locations"))
    groups = pairs.groupBy("blob_id").agg(
        F.count("*").alias("n_objects"),
        F.sum("n_locations").alias("n_locations"),
        F.min("object_id").alias("first_object_id"),
    )
    return groups.filter(F.col("n_objects") > 1)


def merge_parent_edges(stored_edges: DataFrame, children: DataFrame) -> DataFrame:
    """Outcome per parent edge of the delivered children.

    ``children`` has ``child_id, parent_id`` with null for a root or unknown parent. The
    last delivery of a child decides; its other stored edges are removed.
    """
    decided = latest(children, ["child_id"], F.col("ordinal"), ["parent_id"])
    expected = decided.filter(F.col("parent_id").isNotNull()).select("child_id", "parent_id")
    touched = decided.select("child_id")
    existing = stored_edges.join(touched, "child_id", "left_semi")
    side = (
        existing.select("child_id", "parent_id", F.lit(1).alias("old"), F.lit(0).alias("new"))
        .unionByName(expected.select("child_id", "parent_id", F.lit(0).alias("old"), F.lit(1).alias("new")))
    )
    merged = side.groupBy("child_id", "parent_id").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    outcome = (
        F.when(F.col("old") == 0, "inserted").when(F.col("new") == 0, "removed").otherwise("unchanged")
    )
    return merged.select("child_id", "parent_id", outcome.alias("outcome"))


def live_versions(versions: DataFrame, objects: DataFrame) -> DataFrame:
    """The version row whose content is the object's present content."""
    current = objects.select("object_id", "content_hash", F.col("parent_id").alias("live_parent_id"))
    return versions.join(current, ["object_id", "content_hash"], "inner")


def mirror_parents(versions: DataFrame, objects: DataFrame) -> DataFrame:
    """Copy the parent of each object onto its live version."""
    current = objects.select("object_id", "content_hash", F.col("parent_id").alias("_parent"), F.lit(True).alias("_live"))
    joined = versions.join(current, ["object_id", "content_hash"], "left")
    parent = F.when(F.col("_live"), F.col("_parent")).otherwise(F.col("parent_id"))
    return joined.withColumn("parent_id", parent).drop("_parent", "_live")
