"""The photo job: content and identity, metadata, four projections, then one status per photo."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_IDS, IdSpace
from ..operators.extractors import (
    MENTION_TYPE, backend_answers, contexts, output, photo_registry, relation_rows, run_extractor, status_rollup,
    vision_outputs, with_result_id,
)
from ..operators.metadata import backfill_times, backfill_versions, latest_metadata, metadata_diagnostics, project_metadata
from ..operators.upsert import (
    OBJECT_COLUMNS, append_versions, apply_outcomes, attachment_rows, blob_rows, classify, delivery_fingerprint,
    insert_absent, location_rows,
)
from ..session import discard, materialise
from ..sources.content import digest, verify_manifest
from ..sources.manifest import descriptor_error
from ..sources.snapshots import Snapshot, SnapshotLog
from .ingest import identify, import_outcomes, refreshed_versions, reject_reason

# Photo bytes that one batch brings to a Python worker.
BATCH_BYTES = 64 << 20
VISION_BRANCHES = {"photo.caption": "caption", "photo.ocr": "ocr", "photo.objects": "objects"}

def photo_context(objects: DataFrame, attachments: DataFrame, extractions: DataFrame, answers: DataFrame) -> DataFrame:
    """Everything the photo projections read, one row per object.

    ``answers`` holds the backend output per object: ``caption, ocr, objects, width,
    height, runtime`` and errors ``caption_error, ocr_error, objects_error``. Each branch may
    have a runtime of its own (``caption_runtime`` and so on, as ``backend_answers`` gives them).
    """
    derived = latest_metadata(extractions).select(
        "object_id", F.col("metadata_json").alias("derived_json"),
        F.col("extraction_id").alias("metadata_extraction_id"), F.col("status").alias("metadata_status"),
    )
    return contexts(objects, attachments).join(derived, "object_id", "left").join(answers, "object_id", "left")


def run_photo_projections(context: DataFrame, stored_results: DataFrame | None, run_seq: int,
                          ids: IdSpace = DEFAULT_IDS) -> DataFrame:
    """Results of caption, OCR, objects and place; a failed branch leaves the others alone."""
    results = []
    for spec in photo_registry().list():
        branch = VISION_BRANCHES.get(spec.name)
        own_runtime = f"{branch}_runtime" in context.columns
        rows = context.withColumn("runtime", F.col(f"{branch}_runtime")) if own_runtime else context
        column = f"{branch}_error"
        if column in context.columns:
            native = spec.native
            failed = lambda column=column: output(
                F.lit("failed"), diagnostics=F.array(F.concat(F.lit("photo_semantic_failed:"), F.col(column))),
                provenance=F.col("runtime"),
            )
            guarded = lambda native=native, failed=failed, column=column: F.when(
                F.col(column).isNotNull(), failed()
            ).otherwise(native())
            spec = type(spec)(spec.name, spec.version, spec.semantic_type, spec.object_types, native=guarded)
        results.append(run_extractor(rows, stored_results, spec, run_seq, ids))
    return reduce(DataFrame.unionByName, results)


@contextlib.contextmanager
def _batches_of(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Bound the bytes of one batch for Python; a photo larger than that is a batch alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _judged(listing: DataFrame, contents: DataFrame) -> DataFrame:
    """The listing with digest and size of what was read, and why an item cannot be taken.

    Content is hashed where it is read; only digests are shuffled.
    """
    missing = {name: F.lit(None).cast("string") for name in ("content_hash", "metadata_json", "error") if name not in listing.columns}
    listed = listing.withColumns(missing).withColumn("object_type", F.lit("photo")).withColumn("source", F.col("source_kind"))
    if "ordinal" not in listed.columns:
        listed = listed.withColumn("ordinal", F.monotonically_increasing_id())
    failure = F.col("error") if "error" in contents.columns else F.lit(None).cast("string")
    read = digest(contents.withColumn("failure", failure)).groupBy("source_id").agg(
        F.min("sha256").alias("sha256"), F.max("sha256").alias("_other"), F.min("byte_size").alias("_size"), F.min("failure").alias("_failure"))
    verdicts = verify_manifest(listed.filter("content_hash IS NOT NULL").dropDuplicates(["source_id", "content_hash", "byte_size"]),
                               read.select("source_id", "sha256", F.col("_size").alias("byte_size")))
    bad = verdicts.filter("verdict <> 'ok'").groupBy("source_id").agg(F.min("verdict").alias("_verdict"))
    joined = listed.join(read, "source_id", "left").join(bad, "source_id", "left")
    error = F.coalesce(
        "error", descriptor_error(), reject_reason(), "_failure",
        F.when(F.col("sha256").isNull(), "content_missing"), F.when(F.col("sha256") != F.col("_other"), "content_ambiguous"),
        "_verdict", F.when(F.col("byte_size") != F.col("_size"), "byte_size_mismatch"))
    return joined.withColumn("error", error).select(
        "ordinal", "object_type", "source", "source_kind", "source_id", "name", "raw_uri", "mime_type", "metadata_json",
        F.col("sha256").alias("content_hash"), F.col("_size").alias("byte_size"), "error")


def _import_hash(outcomes: DataFrame) -> str:
    """One hash of all contents of an import, in any order, from the hashes they have."""
    number = F.conv(F.substring("content_hash", 1, 15), 16, 10).cast("decimal(20,0)")
    row = outcomes.agg(F.count("*").alias("n"), F.sum(number).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()


def _replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those that come anew; a row that comes anew keeps its creation time."""
    born = stored.select(*keys, F.col("created_at").alias("_born"))
    kept = stored.join(fresh.select(*keys), keys, "left_anti")
    again = fresh.join(born, keys, "left").withColumn("created_at", F.coalesce("_born", "created_at"))
    return kept.unionByName(again.select(*stored.columns))


def import_photos(listing: DataFrame, contents: DataFrame, log: SnapshotLog, backend: Callable[[], object], raw_uri: str, at: str,
                  import_id: str, tags: DataFrame | None = None, ids: IdSpace = DEFAULT_IDS, batch_bytes: int = BATCH_BYTES, **hot) -> Snapshot:
    """Import the photos of a source into an archive: objects to projections, in one snapshot or none.

    ``listing``: descriptors as ``list_photos`` and ``manifest_photos`` give them (``source_id,
    source_kind, name, mime_type, byte_size, modified_at, raw_uri``; optional ``content_hash,
    metadata_json, error, ordinal``). ``contents``: ``source_id, content`` and perhaps ``error``,
    one row per photo. ``backend`` makes a vision backend in each Python worker. ``tags``:
    ``source_kind, source_id`` and the columns of ``photo_metadata``, normalised.

    Every listed item gets a row in ``item_outcomes``. A bad descriptor, content that is missing,
    ambiguous or not what was announced, and an identity conflict are errors of that item; a
    backend that raises fails that one projection of that photo (its status is ``failed``). The
    others go on. Only a listing that cannot be read fails the run, and then nothing changes.

    Photos whose projections are stored for their content are not shown to the backend again;
    their results become current. A repeated listing changes no object. Listings tell no time of
    capture, so the one an object has stays while its content does. Stored rows are read and
    rewritten only in the buckets of delivered keys. An empty listing commits an empty run.
    """
    spark = listing.sparkSession
    row = {"import_id": import_id, "source": "photos", "raw_uri": raw_uri, "source_hash": hashlib.sha256(raw_uri.encode()).hexdigest(), "started_at": at}
    with log.run(row) as started, _batches_of(spark, batch_bytes):
        base = log.current()
        judged = materialise(_judged(listing, contents), "photo-listing")
        items = judged.filter("error IS NULL").withColumns({"captured_at": F.lit(at), "import_id": F.lit(import_id)})
        stored = log.read("objects", base, log.touched("objects", items))
        known = stored.select("source", "source_id", F.col("content_hash").alias("_hash"), F.col("occurred_at").alias("_known"))
        timed = items.join(known, ["source", "source_id"], "left").withColumn("occurred_at", F.when(F.col("_hash") == F.col("content_hash"), F.col("_known")))
        incoming = materialise(identify(timed.drop("_hash", "_known", "source_kind", "name", "error"), ids), "photo-items")
        outcomes = materialise(
            classify(incoming, stored.withColumn("fingerprint", delivery_fingerprint()), **hot).withColumns({
                "parent_id": F.lit(None).cast("string"), "topic": F.lit(None).cast("string"), "created_at": F.lit(at)}), "photo-outcomes")

        # Most tables lie by object, so one look at the delivered keys serves them all.
        by_object = log.touched("object_versions", outcomes)
        near = {name: log.touched(name, outcomes) for name in ("objects", "blobs")} | dict.fromkeys((
            "object_versions", "attachments", "blob_locations", "metadata_extractions", "semantic_results", "semantic_relations", "semantic_runs"), by_object)
        held = {name: log.read(name, base, buckets) for name, buckets in near.items()}
        carried = held["objects"].select("object_id", "event_id", "confidence")
        merged = apply_outcomes(held["objects"], outcomes, OBJECT_COLUMNS).join(carried, "object_id", "left")
        versions = refreshed_versions(held["object_versions"], outcomes).select(*held["object_versions"].columns).unionByName(
            append_versions(held["object_versions"], outcomes, **hot).select(*held["object_versions"].columns))
        dated = lambda df, name="created_at": df.withColumn(name, F.lit(at))
        attachments = materialise(dated(attachment_rows(outcomes)), "photo-attachments")
        staged = {
            "blobs": held["blobs"].unionByName(insert_absent(held["blobs"], blob_rows(outcomes), ["blob_id"]).select(*held["blobs"].columns)),
            "attachments": _replaced(held["attachments"], attachments, ["object_id"]),
            "blob_locations": _replaced(held["blob_locations"], dated(location_rows(outcomes, ids)), ["location_id"]),
        }
        appended = {}
        extractions = held["metadata_extractions"]
        if tags is not None:
            named = tags.withColumn("object_id", ids.object_id(F.col("source_kind"), F.col("source_id"))).drop("source_kind", "source_id")
            targets = merged.join(attachments.select("object_id", "blob_id"), "object_id").select("object_id", "blob_id", "content_hash", "occurred_at")
            told = materialise(project_metadata(targets, named, held["metadata_extractions"], ids), "photo-metadata")
            merged, versions = backfill_times(merged, told), backfill_versions(versions, told)
            rows = dated(told, "extracted_at").select(*extractions.columns)
            extractions = extractions.unionByName(rows)
            appended = {"metadata_extractions": log.stage("metadata_extractions", rows),
                        "metadata_diagnostics": log.stage("metadata_diagnostics", dated(metadata_diagnostics(told)))}
        objects = materialise(merged.select(*held["objects"].columns), "photo-objects")

        # What the backend is asked: photos without a stored result, with the bytes that were hashed.
        delivered = objects.join(attachments.select("object_id"), "object_id", "left_semi")
        context = contexts(delivered, attachments)
        specs = photo_registry().list()
        runs = materialise(reduce(DataFrame.unionByName, [
            with_result_id(context, spec, ids).select(
                "object_id", F.lit(spec.name).alias("extractor_name"), F.lit(spec.semantic_type).alias("semantic_type"),
                "semantic_result_id", F.lit(base.seq + 1).cast("long").alias("run_seq")) for spec in specs]), "photo-runs")
        unasked = runs.filter(F.col("extractor_name").isin(*VISION_BRANCHES)).join(held["semantic_results"].select("semantic_result_id"), "semantic_result_id", "left_anti")
        pending = delivered.join(unasked.select("object_id").distinct(), "object_id", "left_semi").select("object_id", "source_id", "content_hash")
        shown = contents.select("source_id", "content").join(pending, "source_id").filter(F.sha2("content", 256) == F.col("content_hash"))
        answers = materialise(backend_answers(vision_outputs(shown, backend)), "photo-answers")
        # Content that came twice has two answers. Only ids are shuffled to see it, and only such answers then.
        twice = answers.groupBy("object_id").count().filter("count > 1").select("object_id")
        asked, again = [answers], answers.join(twice, "object_id", "left_semi")
        if not twice.isEmpty():
            asked.append(materialise(again.dropDuplicates(["object_id"]), "photo-answers-again"))
            answers = answers.join(twice, "object_id", "left_anti").unionByName(asked[1])
        unread = F.lit("OSError: content changed while it was imported")
        lost = F.col("caption_runtime").isNull()
        ready = photo_context(delivered, attachments, extractions, answers).withColumns({
            f"{branch}_error": F.when(lost, unread).otherwise(F.col(f"{branch}_error")) for branch in VISION_BRANCHES.values()})
        made = run_photo_projections(ready, held["semantic_results"], base.seq + 1, ids)

        # This run is the last one of its objects: its results are current, and no others of theirs.
        chosen = runs.select("object_id", "extractor_name", "semantic_type", F.col("semantic_result_id").alias("_chosen"))
        stays = F.when(F.col("_chosen").isNotNull(), F.col("_chosen") == F.col("semantic_result_id")).otherwise(F.col("is_current"))
        before = held["semantic_results"].join(chosen, ["object_id", "extractor_name", "semantic_type"], "left").withColumn("is_current", stays)
        written = dated(made).withColumns({"diagnostics_json": F.to_json("diagnostics"), "is_current": F.lit(True)})
        # Results are written once, as the part that is committed; what more is asked of those made now lies in it, too.
        beside = {"mentions": MENTION_TYPE, "made_now": "boolean"}
        results = before.select(*held["semantic_results"].columns, *[F.lit(None).cast(kind).alias(name) for name, kind in beside.items()]).unionByName(
            written.withColumn("made_now", F.lit(True)).select(*held["semantic_results"].columns, *[F.col(name).cast(kind).alias(name) for name, kind in beside.items()]))
        replaced = {"semantic_results": (near["semantic_results"], log.stage("semantic_results", results, beside))}
        made = log.staged("semantic_results", replaced["semantic_results"][1], beside).filter("made_now")
        for table in asked:
            discard(table)
        statuses = held["semantic_results"].select("semantic_result_id", "object_id", "status").unionByName(made.select("semantic_result_id", "object_id", "status"))
        of_import = statuses.join(runs.select("semantic_result_id"), "semantic_result_id", "left_semi")
        told_items = materialise(
            import_outcomes(judged.select("ordinal", "source_kind", "source_id", "name", "error"), outcomes, status_rollup(of_import, ["object_id"]))
            .withColumn("import_id", F.lit(import_id)), "photo-told")

        staged |= {"objects": objects, "object_versions": versions}
        replaced |= {name: (near[name], log.stage(name, rows)) for name, rows in staged.items()}
        appended |= {
            "semantic_relations": log.stage("semantic_relations", dated(relation_rows(made, ids))),
            "semantic_runs": log.stage("semantic_runs", runs), "item_outcomes": log.stage("item_outcomes", told_items)}
        counts = told_items.groupBy(F.coalesce("ingestion_outcome", F.lit("error")).alias("outcome"), "semantic_status").count().collect()
        stats = {f"{r['outcome']}.{r['semantic_status'] or 'none'}": r["count"] for r in counts}
        scratch = [judged, incoming, outcomes, attachments, objects, runs, told_items]
        done = started | {"status": "complete", "completed_at": at, "source_hash": _import_hash(incoming), "stats_json": json.dumps(stats, sort_keys=True)}
        snapshot = log.commit(base, replaced, appended, label=import_id, run=done)
        for table in scratch:
            discard(table)
        return snapshot
