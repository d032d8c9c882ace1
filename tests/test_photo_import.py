"""The photo job: one bad item leaves the others alone, and a repeated import changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from keepsake.operators import extractors as x
from keepsake.operators.metadata import photo_metadata
from keepsake.plans.ingest import batch_totals
from keepsake.plans.photos import import_photos
from keepsake.sources.snapshots import SnapshotLog
from tests.test_media_and_extractors import TAGS

AT = "2025-01-0{}T00:00:00+00:00"
LISTING = "source_id string, source_kind string, name string, mime_type string, byte_size bigint, modified_at string, raw_uri string, content_hash string, error string"
TABLES = ("objects", "object_versions", "blobs", "attachments", "blob_locations", "semantic_results", "semantic_relations")


def counting(path=None):
    """Makes a backend with fixed answers; content that says so breaks one task, and every call is counted in a file."""
    tasks = x.CAPTION_TASK, x.OCR_TASK

    class Backend:
        def analyze(self, content, task):
            if path:
                with open(path, "a") as out:
                    out.write(task + "\n")
            text = content.decode()
            if text == "bad ocr" and task == tasks[1]:
                raise OSError("no text model")
            if task == tasks[0]:
                return {task: f"a view  of {text}"}
            if task == tasks[1]:
                return " plain\n sign "
            return {"parsed": {task: {"labels": ["person", "tree"], "bboxes": [[1, 2, 20, 15]], "scores": [0.9, "high"]}}, "width": 40, "height": 30, "runtime": {"backend": "fixed"}}

    return Backend


def item(n, **other):
    row = {"source_id": f"f:{n}.jpg", "source_kind": "local_folder", "name": f"{n}.jpg", "mime_type": "image/jpeg", "byte_size": None,
           "modified_at": "2025-01-01T00:00:00+00:00", "raw_uri": f"file:///p/{n}.jpg", "content_hash": None, "error": None} | other
    return tuple(row[name.split()[0]] for name in LISTING.split(", "))


def frames(spark, items, contents):
    return spark.createDataFrame(items, LISTING), spark.createDataFrame(contents, "source_id string, content binary, note string")


def state(log):
    return {name: sorted(map(str, log.read(name).drop("captured_at").collect())) for name in TABLES}


def outcomes(log, run):
    return {r.filename: (r.ingestion_outcome, r.semantic_status, r.error) for r in log.read("item_outcomes").filter(F.col("import_id") == run).collect()}


def test_failures_stay_with_their_item(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    calls = str(tmp_path / "calls")
    items = [item("a"), item("b"), item("gone"), item("short", byte_size=99), item("wrong", content_hash="0" * 64, byte_size=5), item("none", name=""),
             item("late", modified_at="yesterday"), item("listed", error="trashed"), item("two"), item("same")]
    bodies = {"a": "sea", "b": "bad ocr", "short": "s", "wrong": "wrong", "none": "n", "late": "l", "listed": "x", "same": "sea"}
    contents = [(f"f:{n}.jpg", body.encode(), None) for n, body in bodies.items()] + [("f:two.jpg", b"1", None), ("f:two.jpg", b"2", None)]
    listing, content = frames(spark, items, contents)
    import_photos(listing, content, log, counting(calls), "file:///p", AT.format(1), "run1")
    told = outcomes(log, "run1")
    assert told["a.jpg"] == ("inserted", "partial", None) or told["a.jpg"] == ("inserted", "complete", None)
    assert told["b.jpg"][:2] == ("inserted", "failed") and told["same.jpg"] == told["a.jpg"]
    assert {n: e for n, (_, _, e) in told.items() if e} == {
        "gone.jpg": "content_missing", "short.jpg": "byte_size_mismatch", "wrong.jpg": "content_hash_mismatch", "": "identity_missing",
        "late.jpg": told["late.jpg"][2], "listed.jpg": "trashed", "two.jpg": "content_ambiguous"} and told["late.jpg"][2]
    assert batch_totals(log.read("item_outcomes")).first().asDict() == {"n_items": 10, "n_succeeded": 2, "n_failed": 8}
    assert len(open(calls).readlines()) == 9
    assert (log.read("objects").count(), log.read("blobs").count(), log.read("semantic_results").count()) == (3, 2, 12)

    named = {r.object_id: r.source_id for r in log.read("objects").collect()}
    found = {(named[r.object_id], r.extractor_name): r for r in log.read("semantic_results").collect()}
    ocr, seen = found["f:a.jpg", "photo.ocr"], found["f:a.jpg", "photo.objects"]
    assert ocr.result_text == "plain sign" and found["f:a.jpg", "photo.caption"].result_text == "a view of sea"
    first, second = json.loads(seen.result_json)["detections"]
    assert first["bbox_normalized"] == [0.025, 0.066667, 0.5, 0.5] and "confidence" not in second and seen.confidence == 0.9
    assert json.loads(seen.provenance_json)["extractor"]["runtime"] == {"backend": "fixed"}
    failed = found["f:b.jpg", "photo.ocr"]
    assert failed.status == "failed" and json.loads(failed.diagnostics_json) == ["photo_semantic_failed:OSError: no text model"]
    assert json.loads(failed.provenance_json)["extractor"]["runtime"] == {"backend": "Backend", "task": x.OCR_TASK}

    before = state(log)
    import_photos(listing, content, log, counting(calls), "file:///p", AT.format(2), "run2")
    assert state(log) == before and len(open(calls).readlines()) == 9
    assert outcomes(log, "run2")["a.jpg"] == ("unchanged", *told["a.jpg"][1:])
    runs = {r.import_id: r for r in log.runs().collect()}
    assert runs["run2"].status == "complete" and runs["run1"].source_hash == runs["run2"].source_hash


def test_changed_content_and_back(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    calls = str(tmp_path / "calls")
    for n, body in enumerate((b"one", b"two", b"one"), 1):
        import_photos(*frames(spark, [item("a"), item("a")], [("f:a.jpg", body, None)]), log, counting(calls), "file:///p", AT.format(n), f"run{n}")
    assert (log.read("objects").count(), log.read("object_versions").count(), log.read("semantic_results").count()) == (1, 2, 8)
    current = log.read("semantic_results").filter("is_current")
    assert {r.result_text for r in current.filter("extractor_name = 'photo.caption'").collect()} == {"a view of one"} and current.count() == 4
    assert sorted(r.ingestion_outcome for r in log.read("item_outcomes").collect()) == ["changed", "changed", "inserted", "unchanged", "unchanged", "unchanged"]
    assert len(open(calls).readlines()) == 6
    assert log.read("objects").first().created_at == AT.format(1)


def test_tags_bring_time_and_place(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    record = ("x", True, "2025:03:04 05:06:07", None, "+11:00", "Acme", "M1", 6, 64, 48, ("N", [48.0, 30.0, 0.0], "E", [142.0, 45.0, 0.0]))
    tags = photo_metadata(spark.createDataFrame([record], TAGS).drop("object_id")).withColumns({"source_kind": F.lit("local_folder"), "source_id": F.lit("f:a.jpg")})
    for n in (1, 2):
        import_photos(*frames(spark, [item("a"), item("b")], [("f:a.jpg", b"one", None), ("f:b.jpg", b"two", None)]), log, counting(), "file:///p", AT.format(n), f"run{n}", tags=tags)
        rows = {r.source_id: r for r in log.read("objects").collect()}
        assert rows["f:a.jpg"].occurred_at == "2025-03-04T05:06:07+11:00" and rows["f:b.jpg"].occurred_at is None
    places = log.read("semantic_relations").filter("relation_type = 'semantic_mentions_place'").collect()
    assert [r.target_ref for r in places] == ["geo:48.500000,142.750000"]
    assert outcomes(log, "run2")["a.jpg"][0] == "unchanged" and log.read("metadata_extractions").count() == 1
    assert {r.occurred_at for r in log.read("object_versions").collect()} == {"2025-03-04T05:06:07+11:00", None}


def test_backend_that_cannot_be_made_and_empty_listing(spark, tmp_path):
    def broken():
        raise RuntimeError("no weights")

    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    import_photos(*frames(spark, [item("a")], [("f:a.jpg", b"one", None)]), log, broken, "file:///p", AT.format(1), "run1")
    assert outcomes(log, "run1")["a.jpg"] == ("inserted", "failed", None)
    assert {r.extractor_name: r.status for r in log.read("semantic_results").collect()} == {
        "photo.caption": "failed", "photo.ocr": "failed", "photo.objects": "failed", "photo.place": "complete"}
    before = state(log)
    empty = spark.createDataFrame([], "source_id string, content binary")
    import_photos(spark.createDataFrame([], LISTING), empty, log, counting(), "file:///p", AT.format(2), "run2")
    assert state(log) == before and {r.status for r in log.runs().collect()} == {"complete"}
    with pytest.raises(Exception):
        import_photos(spark.createDataFrame([item("a")], LISTING).drop("name"), empty, log, counting(), "file:///p", AT.format(3), "run3")
    assert state(log) == before and {r.import_id: r.status for r in log.runs().collect()}["run3"] == "failed"


def test_batches_are_bounded_by_bytes(spark):
    from keepsake.plans.photos import _batches_of

    photos = spark.range(0, 12, 1, 1).select(F.col("id").cast("string").alias("object_id"), F.encode(F.repeat(F.lit("x"), 100_000), "utf-8").alias("content"))
    sizes = lambda: [r.n for r in photos.mapInPandas(lambda batches: (b.head(1)[["object_id"]].assign(n=len(b))[["n"]] for b in batches), "n int").collect()]
    assert sizes() == [12]
    with _batches_of(spark, 250_000):
        assert max(sizes()) <= 3 and sum(sizes()) == 12
    assert sizes() == [12]


def test_results_are_written_once_and_content_that_came_twice_counts_once(spark, tmp_path, monkeypatch):
    from keepsake.plans import photos

    labels, write = [], photos.materialise
    monkeypatch.setattr(photos, "materialise", lambda df, label: labels.append(label) or write(df, label))
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    contents = [("f:a.jpg", b"one", None), ("f:b.jpg", b"two", None), ("f:b.jpg", b"two", None)]
    import_photos(*frames(spark, [item("a"), item("b")], contents), log, counting(), "file:///p", AT.format(1), "run1")
    assert "photo-results" not in labels and "photo-answers-again" in labels
    results = log.read("semantic_results")
    assert results.count() == 8 == results.select("semantic_result_id").distinct().count()
    assert log.read("semantic_relations").filter("target_ref = 'object:person'").count() == 2
    assert "mentions" not in results.columns
