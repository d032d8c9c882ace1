"""Ingest: identity, blobs, outcomes and versions of small batches."""

import hashlib
import uuid

from pyspark.sql import functions as F

from keepsake.contracts import TABLES
from keepsake.functions.ids import DEFAULT_IDS
from keepsake.operators.upsert import OBJECT_COLUMNS, duplicate_blobs
from keepsake.plans.ingest import ingest, refreshed_versions, split_items

ITEM = (
    "ordinal bigint, object_type string, source string, source_id string, raw_uri string, content binary, "
    "occurred_at string, captured_at string, mime_type string, metadata_json string"
)
VERSION = "object_id string, content_hash string, version bigint, object_type string, occurred_at string, captured_at string, raw_uri string, mime_type string, metadata_json string"


def items(spark, *rows):
    base = dict(ordinal=0, object_type="photo", source="cam", source_id=None, raw_uri="file:///a.jpg", content=b"x",
                occurred_at=None, captured_at="2025-01-01T00:00:00+00:00", mime_type="image/jpeg", metadata_json="{}")
    data = [tuple({**base, "ordinal": i, **row}[name.split()[0]] for name in ITEM.split(", ")) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, ITEM)


def empty(spark):
    objects = spark.createDataFrame([], TABLES["objects"].schema).select(*OBJECT_COLUMNS)
    return objects, spark.createDataFrame([], VERSION)


def run(spark, batch, objects, versions):
    result = ingest(batch, objects, versions)
    grown = versions.unionByName(result.new_versions.select(*versions.columns))
    # Freeze: the next run must see the state, not the plan.
    return result, spark.createDataFrame(result.objects.collect(), result.objects.schema), spark.createDataFrame(grown.collect(), grown.schema)


def test_new_photo_then_again(spark):
    batch = items(spark, {})
    result, objects, versions = run(spark, batch, *empty(spark))
    row = result.outcomes.first()
    assert row["outcome"] == "inserted" and row["source_id"] == "file:///a.jpg"
    assert row["content_hash"] == hashlib.sha256(b"x").hexdigest()
    assert row["object_id"] == "kps_obj_" + uuid.uuid5(DEFAULT_IDS.namespace, "object:cam:file:///a.jpg").hex
    stored = objects.first()
    assert stored["created_at"] == stored["captured_at"]
    again, objects2, versions2 = run(spark, batch, objects, versions)
    assert again.outcomes.first()["outcome"] == "unchanged"
    assert objects2.collect() == objects.collect() and versions2.collect() == versions.collect()


def test_same_bytes_two_places(spark):
    batch = items(spark, {}, {"raw_uri": "file:///b.jpg"})
    result, objects, _ = run(spark, batch, *empty(spark))
    assert objects.count() == 2 and result.blobs.count() == 1 and result.locations.count() == 2
    group = duplicate_blobs(result.locations).first()
    assert (group["n_objects"], group["n_locations"]) == (2, 2)


def test_notes_have_no_blob_media_do(spark):
    batch = items(spark, {"object_type": "note", "raw_uri": "n"}, {"object_type": "video", "raw_uri": "v", "content": b"v"}, {"object_type": "audio", "raw_uri": "a", "content": b"a"})
    result, _, _ = run(spark, batch, *empty(spark))
    assert result.blobs.count() == 2 and result.attachments.count() == 2


def test_change_and_revert_adds_one_version(spark):
    state = empty(spark)
    for content, outcome, n_versions in ((b"one", "inserted", 1), (b"two", "changed", 2), (b"one", "changed", 2)):
        result, *state = run(spark, items(spark, {"content": content, "source_id": "1"}), *state)
        assert result.outcomes.first()["outcome"] == outcome and state[1].count() == n_versions


def test_metadata_change_refreshes_known_version(spark):
    _, objects, versions = run(spark, items(spark, {"source_id": "1"}), *empty(spark))
    result, _, grown = run(spark, items(spark, {"source_id": "1", "metadata_json": '{"b":1, "a":2}'}), objects, versions)
    assert result.outcomes.first()["outcome"] == "changed" and grown.count() == 1
    fresh = refreshed_versions(versions, result.outcomes).first()
    assert fresh["refreshed"] and fresh["metadata_json"] == '{"a":2,"b":1}'


def test_capture_time_alone_is_no_change(spark):
    _, objects, versions = run(spark, items(spark, {"source_id": "1"}), *empty(spark))
    result, _, _ = run(spark, items(spark, {"source_id": "1", "captured_at": "2026-01-01T00:00:00+00:00"}), objects, versions)
    assert result.outcomes.first()["outcome"] == "unchanged"


def test_bad_items_are_set_aside(spark):
    batch = items(spark, {"object_type": "spreadsheet"}, {"source": ""}, {"metadata_json": "[]"}, {})
    valid, rejected = split_items(batch)
    assert valid.count() == 1
    assert {row["reason"] for row in rejected.collect()} == {"unsupported_object_type", "source_and_raw_uri_required", "metadata_not_an_object"}


def test_native_uuid_equals_library(spark):
    names = ["", "a", "Ünïcode ✓ 😀", "снег", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", DEFAULT_IDS._id("t", F.col("n")).alias("u"))
    for row in df.collect():
        assert row["u"] == "kps_t_" + uuid.uuid5(DEFAULT_IDS.namespace, row["n"]).hex
