"""Jobs that run Python over content: the photo import, a Python extractor, and appended logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import shared_dir
from keepsake.operators import extractors as x
from keepsake.plans.photos import import_photos
from keepsake.sources.snapshots import SnapshotLog
from keepsake.sources.tables import append_audit, write_report

from .fragments import collapse
from .registry import query
from .views import load

SHORT, LONG = 40, 500


def text_backend():
    """A backend over texts: captions are the text, every fifth length breaks text recognition."""
    caption, ocr = x.CAPTION_TASK, x.OCR_TASK

    class TextBackend:
        def analyze(self, content, task):
            if task == caption:
                return {task: content.decode()}
            if task == ocr:
                if len(content) % 5 == 0:
                    raise ValueError("no text model")
                return content.decode()
            return {"parsed": {task: {"labels": ["person"], "bboxes": [[0, 0, 20, 15]], "scores": [len(content) % 7 / 10]}}, "width": 40, "height": 30}

    return TextBackend


def photo_archive(spark, d):
    """Every document as a photo; some are listed as broken, not there, or of another size."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    text = n.cast("string")
    bytes_of = F.encode("text", "utf-8")
    listing = docs.select(
        F.concat(F.lit("docs:"), text).alias("source_id"), F.lit("local_folder").alias("source_kind"), F.concat(text, F.lit(".jpg")).alias("name"),
        F.lit("image/jpeg").alias("mime_type"), (F.octet_length(bytes_of) + F.when(n % 17 == 0, 1).otherwise(0)).cast("long").alias("byte_size"),
        F.when(n % 29 == 0, "yesterday").otherwise("2024-06-01T00:00:00+00:00").alias("modified_at"),
        F.concat(F.lit("file:///p/"), text, F.lit(".jpg")).alias("raw_uri"), F.when(n % 23 == 0, "trashed").alias("error"))
    contents = docs.filter(n % 19 != 0).select(F.concat(F.lit("docs:"), text).alias("source_id"), bytes_of.alias("content"))
    log = SnapshotLog(spark, shared_dir(spark, "photo-archive"), buckets=16)
    import_photos(listing, contents, log, text_backend(), "file:///p", "2024-06-02T00:00:00+00:00", "run-1")
    return log


TAKEN = "doc_id % 29 <> 0 AND doc_id % 23 <> 0 AND doc_id % 19 <> 0 AND text IS NOT NULL AND doc_id % 17 <> 0"
STATUS = f"CASE WHEN strlen(text) % 5 = 0 THEN 'failed' WHEN {collapse('text')} = '' THEN 'partial' ELSE 'complete' END"


@query("photo_import", f"""SELECT doc_id || '.jpg' AS filename, 'docs:' || doc_id AS source_id, CASE WHEN {TAKEN} THEN 'inserted' END AS ingestion_outcome, CASE WHEN {TAKEN} THEN {STATUS} END AS semantic_status,
 CASE WHEN doc_id % 23 = 0 THEN 'trashed' WHEN doc_id % 29 = 0 THEN 'invalid:modified_at' WHEN doc_id % 19 = 0 OR text IS NULL THEN 'content_missing' WHEN doc_id % 17 = 0 THEN 'byte_size_mismatch' END AS error FROM documents""")
def photo_import(spark, d):
    return photo_archive(spark, d).read("item_outcomes").select("filename", "source_id", "ingestion_outcome", "semantic_status", "error")


@query("photo_import_results", f"""SELECT source_id, extractor_name, status, confidence, result_text FROM (SELECT 'docs:' || doc_id AS source_id, text FROM documents WHERE {TAKEN}) t, LATERAL (
 SELECT 'photo.caption' AS extractor_name, CASE WHEN {collapse('text')} = '' THEN 'partial' ELSE 'complete' END AS status, CAST(NULL AS DOUBLE) AS confidence, {collapse('text')} AS result_text
 UNION ALL SELECT 'photo.ocr', CASE WHEN strlen(text) % 5 = 0 THEN 'failed' ELSE 'complete' END, NULL, CASE WHEN strlen(text) % 5 <> 0 THEN {collapse('text')} END
 UNION ALL SELECT 'photo.objects', 'complete', CAST(strlen(text) % 7 AS DOUBLE) / 10, NULL UNION ALL SELECT 'photo.place', 'complete', NULL, NULL) r""")
def photo_import_results(spark, d):
    log = photo_archive(spark, d)
    names = log.read("objects").select("object_id", "source_id")
    current = log.read("semantic_results").filter("is_current")
    return current.join(names, "object_id").select("source_id", "extractor_name", "status", "confidence", "result_text")


@query("python_extractor", f"""SELECT doc_id, CASE WHEN text IS NULL OR length(text) < {SHORT} THEN 'failed' ELSE 'complete' END AS status, CASE WHEN length(text) >= {SHORT} THEN CAST(length(text) AS VARCHAR) END AS result_text,
 CASE WHEN text IS NULL THEN 'extractor_failed:TypeError: no text' WHEN length(text) < {SHORT} THEN 'extractor_failed:ValueError: text too short' ELSE '' END AS diagnostics, CAST(CASE WHEN length(text) > {LONG} THEN 1 ELSE 0 END AS INT) AS n_mentions FROM documents""")
def python_extractor(spark, d):
    def handler(record):
        text = record["text"]
        if text is None:
            raise TypeError("no text")
        if len(text) < SHORT:
            raise ValueError("text too short")
        mentions = [("semantic_mentions_topic", "topic:long")] if len(text) > LONG else []
        return {"status": "complete", "result_text": str(len(text)), "result_json": {"length": len(text)}, "mentions": mentions}

    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_id"), "doc_id", "text")
    none = F.lit(None).cast("string")
    context = docs.select("object_id", F.lit("note").alias("object_type"), F.lit("docs").alias("source"), F.col("object_id").alias("source_id"), F.lit("u").alias("raw_uri"),
                          F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), none.alias("blob_id"), none.alias("metadata_extraction_id"), none.alias("metadata_status"), "text")
    made = x.run_extractor(context, None, x.ExtractorSpec("length", "1.0.0", "summary", ("note",), python=handler), 1)
    return made.select(F.col("object_id").cast("long").alias("doc_id"), "status", "result_text", F.array_join("diagnostics", ",").alias("diagnostics"), F.size("mentions").alias("n_mentions"))


@query("audit_append", """SELECT endpoint, count(*) AS n_requests, CAST(count(*) FILTER (endpoint = 'error') AS BIGINT) AS n_errors, count(DISTINCT sha256(principal)) AS n_principals FROM v_audit GROUP BY endpoint""", views=("v_audit",))
def audit_append(spark, d):
    rows = load(spark, d, "v_audit").select(
        F.timestamp_micros("stamp").cast("string").alias("timestamp"), "request_id", "endpoint", F.when(F.col("endpoint") == "error", 500).otherwise(200).alias("http_status"),
        F.col("value").alias("latency_ms"), F.lit(0).alias("result_count"), F.sha2("principal", 256).alias("principal_hash"))
    path = shared_dir(spark, "audit-log")
    odd = F.pmod(F.xxhash64("request_id"), F.lit(2)) == 1
    append_audit(rows.filter(odd), path)
    append_audit(rows.filter(~odd), path)
    log = spark.read.schema(rows.schema).json(path)
    report = log.groupBy("endpoint").agg(F.count("*").alias("n_requests"), F.count_if(F.col("http_status") == 500).alias("n_errors"), F.count_distinct("principal_hash").alias("n_principals"))
    out = shared_dir(spark, "audit-report")
    write_report(report, out)
    return spark.read.schema(report.schema).json(out)
