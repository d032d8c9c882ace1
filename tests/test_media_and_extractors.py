"""Metadata normalisation, extractor outputs, registry, current projection."""

import json

import pytest
from pyspark.sql import functions as F

from keepsake.operators import extractors as x
from keepsake.operators.metadata import backfill_times, photo_metadata, video_metadata

TAGS = (
    "object_id string, has_exif boolean, date_time_original string, date_time_digitized string, offset_time string, make string, model string, "
    "orientation int, width int, height int, gps struct<lat_ref:string,lat:array<double>,lon_ref:string,lon:array<double>>"
)


def test_photo_tags(spark):
    taken = "2025:03:04 05:06:07"
    rows = [
        ("full", True, taken, taken, "+11:00", "Acme", "M1", 6, 64, 48, ("N", [48.0, 30.0, 0.0], "E", [142.0, 45.0, 0.0])),
        ("none", False, None, None, None, None, None, None, 64, 48, None),
        ("clash", True, taken, "2025:03:04 05:06:08", "+11:00", "Acme", None, 1, 64, 48, ("S", [48.0, 30.0, 0.0], "W", [200.0, 0.0, 0.0])),
    ]
    done = {r["object_id"]: r for r in photo_metadata(spark.createDataFrame(rows, TAGS)).collect()}
    codes = {name: [d["code"] for d in row["diagnostics"]] for name, row in done.items()}
    full = done["full"]
    assert (full["occurred_at"], full["latitude"], full["longitude"], full["status"]) == ("2025-03-04T05:06:07+11:00", 48.5, 142.75, "complete")
    assert json.loads(full["metadata_json"])["dimensions"] == {"height": 48, "width": 64}
    assert codes["none"] == ["photo.gps_missing", "photo.exif_missing", "photo.capture_time_missing", "photo.camera_missing"]
    assert codes["clash"] == ["photo.gps_invalid", "photo.capture_time_conflict"] and done["clash"]["occurred_at"] is None


def test_video_tracks(spark):
    rows = [
        ("full", {"encoded_date": "UTC 2025-04-05 06:07:08", "duration": "3500", "Recorded_Location": "+48.5000+142.7500/"}, {"format": "AVC", "width": "1920", "height": "1080"}),
        ("naive", {"encoded_date": "2025-04-05 06:07:08", "duration": "long"}, {}),
        ("two", {"encoded_date": "UTC 2025-04-05 06:07:08", "tagged_date": "2025-04-05 06:07:09.5 UTC"}, {"width": "wide"}),
    ]
    df = spark.createDataFrame(rows, "object_id string, general map<string,string>, video map<string,string>")
    done = {r["object_id"]: r for r in video_metadata(df).collect()}
    codes = {name: [d["code"] for d in row["diagnostics"]] for name, row in done.items()}
    full = done["full"]
    assert (full["occurred_at"], full["duration_seconds"], full["latitude"], full["width"], full["status"]) == ("2025-04-05T06:07:08+00:00", 3.5, 48.5, 1920, "complete")
    assert codes["naive"] == ["video.creation_timezone_missing", "video.gps_missing", "video.track_missing", "video.duration_invalid"]
    assert done["two"]["status"] == "failed" and codes["two"] == ["video.extraction_failed"]


def test_detections_and_mentions(spark):
    schema = "objects struct<labels:array<string>,bboxes:array<array<double>>,scores:array<double>>, width int, height int, runtime string"
    df = spark.createDataFrame([((["person", "bicycle"], [[1.0, 2.0, 20.0, 15.0]], [0.91, 0.83]), 40, 30, "{}"), ((["car", " "], [], []), 40, 30, "{}")], schema)
    first, second = [r["out"] for r in df.select(x.detection_output().alias("out")).collect()]
    assert first["confidence"] == 0.87 and [m["target_ref"] for m in first["mentions"]] == ["object:person", "object:bicycle"]
    detections = json.loads(first["result_json"])["detections"]
    assert detections[0]["bbox_normalized"] == [0.025, 0.066667, 0.5, 0.5] and "bbox" not in detections[1]
    assert second["confidence"] is None and second["diagnostics"] == ["model_confidence_unavailable"] and len(second["mentions"]) == 1


CONTEXT = "object_id string, object_type string, source string, source_id string, raw_uri string, content_hash string, blob_id string, metadata_extraction_id string, metadata_status string, text string"


def context(spark, digest="h1"):
    rows = [("o1", "note", "s", "1", "u", digest, None, None, None, " two   words "), ("o2", "photo", "s", "2", "u", digest, "b", None, None, None)]
    return spark.createDataFrame(rows, CONTEXT)


def test_run_is_idempotent_and_versions_take_turns(spark):
    one = x.ExtractorSpec("t", "1.0.0", "t", ("note",), native=x.normalize_text_output)
    two = x.ExtractorSpec("t", "2.0.0", "t", ("note",), native=x.normalize_text_output)
    first = x.run_extractor(context(spark), None, one, 1)
    rows = {r["object_id"]: r for r in first.collect()}
    assert rows["o1"]["result_text"] == "two words" and json.loads(rows["o1"]["result_json"]) == {"character_count": 9}
    assert rows["o2"]["status"] == "unsupported" and json.loads(rows["o1"]["provenance_json"])["extractor"]["runtime"] == {}
    assert x.run_extractor(context(spark), first, one, 2).count() == 0
    assert x.run_extractor(context(spark, "h2"), first, one, 2).count() == 2
    second = x.run_extractor(context(spark), first, two, 2)
    results = first.unionByName(second)
    log = results.select("object_id", "extractor_name", "semantic_type", "semantic_result_id", "run_seq")
    assert {(r["extractor_version"], r["is_current"]) for r in x.mark_current(results, log).collect()} == {("1.0.0", False), ("2.0.0", True)}
    again = log.unionByName(first.select(*log.columns).withColumn("run_seq", F.lit(3).cast("long")))
    assert {(r["extractor_version"], r["is_current"]) for r in x.mark_current(results, again).collect()} == {("1.0.0", True), ("2.0.0", False)}


def test_python_handler_and_its_failures(spark):
    def handler(record):
        if record["text"].strip() == "two   words":
            return {"status": "complete", "confidence": 0.5, "result_json": {"b": 1, "a": 2}, "mentions": [("semantic_mentions_topic", "topic:x", 0.25)]}
        raise RuntimeError("no model")

    rows = context(spark).filter("object_type = 'note'")
    rows = rows.unionByName(rows.withColumn("object_id", F.lit("o9")).withColumn("text", F.lit("bad")))
    results = x.run_extractor(rows, None, x.ExtractorSpec("p", "1", "p", ("note",), python=handler), 1)
    done = {r["object_id"]: r for r in results.collect()}
    assert done["o1"]["result_json"] == '{"a":2,"b":1}' and done["o9"]["status"] == "failed"
    assert done["o9"]["diagnostics"] == ["extractor_failed:RuntimeError: no model"]
    relations = x.relation_rows(results)
    assert sorted(r["relation_type"] for r in relations.filter("object_id = 'o1'").collect()) == ["object_has_semantic_result", "semantic_mentions_topic"]


def test_vision_backend_branches_fail_alone(spark):
    class FixedBackend:
        def analyze(self, content, task):
            if task == "<OCR_WITH_REGION>":
                raise OSError("no text model")
            return {"labels": [task], "size": len(content)}

    photos = spark.createDataFrame([("o1", b"abc")], "object_id string, content binary")
    row = x.vision_outputs(photos, FixedBackend).first()
    assert json.loads(row["caption_answer"])["size"] == 3 and row["ocr_answer"] is None and row["ocr_error"] == "OSError: no text model"


def test_registry():
    registry = x.ExtractorRegistry()
    for version in ("9.0.0", "10.0.0"):
        registry.register(x.ExtractorSpec("e", version, "e", ("note",)))
    assert registry.get("e").version == "10.0.0" and registry.get("e", "9.0.0").version == "9.0.0"
    with pytest.raises(ValueError):
        registry.register(x.ExtractorSpec("e", "9.0.0", "e", ("note",)))
    with pytest.raises(KeyError):
        registry.get("nothing")


def test_backfill_keeps_known_times(spark):
    objects = spark.createDataFrame([("a", None), ("b", "known")], "object_id string, occurred_at string")
    extractions = spark.createDataFrame([("a", "x", "derived", True), ("b", "y", "other", False)], "object_id string, extraction_id string, occurred_at string, backfill boolean")
    assert {r["object_id"]: r["occurred_at"] for r in backfill_times(objects, extractions).collect()} == {"a": "derived", "b": "known"}
