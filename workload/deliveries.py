"""Ingest of item batches, listings, manifests and the sinks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.ids import DEFAULT_IDS
from keepsake.operators import quality
from keepsake.operators.upsert import (
    blob_rows, classify, duplicate_blobs, insert_absent, location_rows,
)
from keepsake.plans.ingest import (
    batch_totals, identify, import_outcomes, ingest, refreshed_versions, split_items,
)
from keepsake.sources import folders, manifest
from keepsake.sources.content import digest, verify_manifest
from keepsake.sources.tables import audit_problem, outcome_stats

from .dialects import blob_id, object_id
from .fragments import DUCK
from .registry import query
from .views import load

FP = "content_hash || '|' || object_type || '|' || raw_uri || '|' || mime_type || '|' || metadata_json || '|' || coalesce(occurred_at, '~')"

# Outcome per delivered row, by plain SQL windows.
OUTCOME_CTES = f""", inc AS (SELECT *, {object_id(DUCK, 'source', 'source_id')} AS object_id, {FP} AS fp FROM v_items2),
known AS (SELECT source, source_id, object_id AS stored_id, content_hash AS stored_hash, {FP} AS stored_fp FROM v_stored),
lagged AS (SELECT inc.*, lag(fp) OVER w AS prev_fp, lag(content_hash) OVER w AS prev_hash FROM inc WINDOW w AS (PARTITION BY source, source_id ORDER BY ordinal)),
judged AS (SELECT l.*, k.stored_id, k.stored_hash, k.stored_fp,
  CASE WHEN k.stored_id <> l.object_id THEN 'conflict' WHEN coalesce(prev_fp, stored_fp) IS NULL THEN 'inserted'
       WHEN coalesce(prev_fp, stored_fp) = fp THEN 'unchanged' ELSE 'changed' END AS outcome,
  CASE WHEN k.stored_id <> l.object_id THEN 'conflict' WHEN coalesce(prev_hash, stored_hash) IS NULL THEN 'inserted'
       WHEN coalesce(prev_hash, stored_hash) = content_hash THEN 'unchanged' ELSE 'changed' END AS structural
  FROM lagged l LEFT JOIN known k USING (source, source_id))
"""
DELIVERY = ("v_items2", "v_stored")


def delivered(spark, d):
    return ingest(load(spark, d, "v_items2"), load(spark, d, "v_stored"), load(spark, d, "v_stored_versions"))


@query("ingest_rejects", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unsupported_object_type' WHEN doc_id % 8 = 0 THEN 'source_and_raw_uri_required' ELSE 'metadata_not_an_object' END AS reason
FROM documents WHERE doc_id % 9 = 0 OR doc_id % 8 = 0 OR doc_id % 7 = 0""")
def ingest_rejects(spark, d):
    n = F.col("doc_id")
    items = load(spark, d, "documents").select(
        "doc_id", F.when(n % 9 == 0, "spreadsheet").otherwise("note").alias("object_type"),
        F.when(n % 16 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.when(n % 8 == 0, F.lit("")).otherwise(F.lit("file:///x")).alias("raw_uri"),
        F.when(n % 14 == 0, F.lit("[1]")).when(n % 7 == 0, F.lit("{bad")).otherwise(F.lit("{}")).alias("metadata_json"),
    )
    return split_items(items)[1].select("doc_id", "reason")


@query("ingest_outcomes", OUTCOME_CTES + "SELECT ordinal, object_id, outcome FROM judged", views=DELIVERY)
def ingest_outcomes(spark, d):
    return delivered(spark, d).outcomes.select("ordinal", "object_id", "outcome")


@query("upsert_outcomes", OUTCOME_CTES + "SELECT ordinal, structural AS outcome FROM judged", views=DELIVERY)
def upsert_outcomes(spark, d):
    incoming = identify(load(spark, d, "v_items2")).withColumn("fingerprint", F.col("content_hash"))
    stored = load(spark, d, "v_stored").withColumn("fingerprint", F.col("content_hash"))
    return classify(incoming, stored).select("ordinal", "outcome")


@query("ingest_objects", OUTCOME_CTES + """, written AS (SELECT * FROM judged WHERE outcome IN ('inserted', 'changed') QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY ordinal DESC) = 1)
SELECT source, source_id, coalesce(w.object_id, s.object_id) AS object_id, coalesce(w.content_hash, s.content_hash) AS content_hash,
  CASE WHEN w.object_id IS NULL THEN s.occurred_at ELSE w.occurred_at END AS occurred_at, coalesce(w.captured_at, s.captured_at) AS captured_at,
  coalesce(w.metadata_json, s.metadata_json) AS metadata_json, coalesce(s.created_at, w.captured_at) AS created_at
FROM v_stored s FULL JOIN written w USING (source, source_id)""", views=DELIVERY)
def ingest_objects(spark, d):
    return delivered(spark, d).objects.select(
        "source", "source_id", "object_id", "content_hash", "occurred_at", "captured_at", "metadata_json", "created_at")


@query("object_versions", OUTCOME_CTES + """, seen AS (SELECT object_id, content_hash, min(ordinal) AS ordinal FROM judged WHERE outcome <> 'conflict' GROUP BY ALL),
fresh AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM v_stored_versions v WHERE v.object_id = s.object_id AND v.content_hash = s.content_hash)),
top AS (SELECT object_id, max(version) AS v FROM v_stored_versions GROUP BY object_id)
SELECT object_id, content_hash, ordinal, CAST(coalesce(v, 0) + row_number() OVER (PARTITION BY object_id ORDER BY ordinal) AS BIGINT) AS version FROM fresh LEFT JOIN top USING (object_id)""",
       views=("v_items2", "v_stored", "v_stored_versions"))
def object_versions(spark, d):
    return delivered(spark, d).new_versions.select("object_id", "content_hash", "ordinal", "version")


@query("version_refresh", OUTCOME_CTES + """, ch AS (SELECT * FROM judged WHERE outcome = 'changed' QUALIFY row_number() OVER (PARTITION BY object_id, content_hash ORDER BY ordinal DESC) = 1)
SELECT v.object_id, v.version, c.object_id IS NOT NULL AS refreshed, coalesce(c.metadata_json, v.metadata_json) AS metadata_json, coalesce(c.captured_at, v.captured_at) AS captured_at
FROM v_stored_versions v LEFT JOIN ch c ON c.object_id = v.object_id AND c.content_hash = v.content_hash""",
       views=("v_items2", "v_stored", "v_stored_versions"))
def version_refresh(spark, d):
    versions = load(spark, d, "v_stored_versions")
    return refreshed_versions(versions, delivered(spark, d).outcomes).select("object_id", "version", "refreshed", "metadata_json", "captured_at")


@query("blob_tables", OUTCOME_CTES + f""", bin AS (SELECT * FROM judged WHERE object_type IN ('photo','video','audio') AND outcome <> 'conflict'),
b AS (SELECT {blob_id('content_hash')} AS blob_id, arg_min(byte_size, ordinal) AS n FROM bin GROUP BY content_hash),
a AS (SELECT object_id, {blob_id('arg_max(content_hash, ordinal)')} AS blob_id FROM bin GROUP BY object_id),
l AS (SELECT object_id, raw_uri, {blob_id('arg_max(content_hash, ordinal)')} AS blob_id FROM bin GROUP BY object_id, raw_uri)
SELECT 'blob' AS kind, blob_id AS id, blob_id, n FROM b UNION ALL SELECT 'attachment', object_id, blob_id, NULL FROM a
UNION ALL SELECT 'location', '{DEFAULT_IDS.prefix}_loc_' || {DUCK.uuid("('location:' || object_id || ':' || raw_uri)")}, blob_id, NULL FROM l""", views=DELIVERY)
def blob_tables(spark, d):
    result = delivered(spark, d)
    none = F.lit(None).cast("bigint").alias("n")
    return (
        result.blobs.select(F.lit("blob").alias("kind"), F.col("blob_id").alias("id"), "blob_id", F.col("byte_size").alias("n"))
        .unionByName(result.attachments.select(F.lit("attachment").alias("kind"), F.col("object_id").alias("id"), "blob_id", none))
        .unionByName(result.locations.select(F.lit("location").alias("kind"), F.col("location_id").alias("id"), "blob_id", none))
    )


@query("blob_dedup", f""", bin AS (SELECT *, {object_id(DUCK, 'source', 'source_id')} AS object_id FROM v_items1 WHERE object_type IN ('photo','video','audio'))
SELECT {blob_id('content_hash')} AS blob_id, count(DISTINCT object_id) AS n_objects, count(DISTINCT object_id || raw_uri) AS n_locations, min(object_id) AS first_object_id
FROM bin GROUP BY content_hash HAVING count(DISTINCT object_id) > 1""", views=("v_items1",))
def blob_dedup(spark, d):
    items = identify(load(spark, d, "v_items1")).withColumn("outcome", F.lit("inserted"))
    return duplicate_blobs(location_rows(items))


@query("insert_absent", f"""SELECT {blob_id('content_hash')} AS blob_id, min(byte_size) AS byte_size FROM v_items2
WHERE content_hash NOT IN (SELECT sha256 FROM v_blobs) GROUP BY content_hash""", views=("v_items2", "v_blobs"))
def insert_absent_blobs(spark, d):
    incoming = load(spark, d, "v_items2").select(DEFAULT_IDS.blob_id(F.col("content_hash")).alias("blob_id"), "byte_size")
    return insert_absent(load(spark, d, "v_blobs"), incoming, ["blob_id"])


@query("import_run_stats", OUTCOME_CTES + """SELECT object_type, '{"changed":' || count(*) FILTER (outcome = 'changed') || ',"conflict":' || count(*) FILTER (outcome = 'conflict')
 || ',"inserted":' || count(*) FILTER (outcome = 'inserted') || ',"unchanged":' || count(*) FILTER (outcome = 'unchanged') || '}' AS stats_json FROM judged GROUP BY object_type""", views=DELIVERY)
def import_run_stats(spark, d):
    return outcome_stats(delivered(spark, d).outcomes, ["object_type"])


@query("audit_shape", """SELECT request_id, substring(sha256(principal), 1, 24) AS principal_hash, endpoint, CAST(CASE WHEN endpoint = 'error' THEN 500 ELSE 200 END AS INT) AS http_status FROM v_audit""", views=("v_audit",))
def audit_shape(spark, d):
    log = load(spark, d, "v_audit").select(
        F.timestamp_micros("stamp").cast("string").alias("timestamp"), "request_id", "endpoint",
        F.when(F.col("endpoint") == "error", 500).otherwise(200).alias("http_status"), F.col("value").alias("latency_ms"),
        F.lit(0).alias("result_count"), F.substring(F.sha2("principal", 256), 1, 24).alias("principal_hash"),
    )
    problem = audit_problem(log)
    if problem:
        raise ValueError(problem)
    if audit_problem(log.withColumn("principal", F.lit("x"))) is None:
        raise ValueError("an extra column must be refused")
    return log.select("request_id", "principal_hash", "endpoint", "http_status")


def listing_pages(spark, d):
    """Provider pages of one file each, with next-page tokens."""
    fields = ("id", "name", "mimeType", "size", "md5Checksum", "modifiedTime", "createdTime", "version")
    n = F.col("page_id")
    token = F.when(n % 50 == 49, "").when(n % 7 == 0, F.concat(F.lit("again-"), (n % 3).cast("string"))).when(
        n % 11 != 0, F.concat(F.lit("t"), n.cast("string")))
    parents = F.array(F.concat(F.lit("folder"), F.col("listing").cast("string")))
    return load(spark, d, "v_manifest").select(
        token.alias("nextPageToken"), F.array(F.struct(*fields, parents.alias("parents"), "trashed")).alias("files"))


IMAGES = "mimeType IN ('image/jpeg','image/png','image/webp','image/heic','image/heif')"
MANIFEST_CTE = f""", m AS (SELECT *, CASE WHEN page_id % 41 = 0 THEN 'invalid:id' WHEN name = '' THEN 'invalid:name' WHEN trashed THEN 'trashed'
  WHEN size IN ('-5', 'big') THEN 'invalid:size' WHEN modifiedTime IS NULL OR modifiedTime = 'yesterday' THEN 'invalid:modifiedTime'
  WHEN NOT regexp_matches(modifiedTime, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN 'no_timezone:modifiedTime' END AS error
  FROM v_manifest WHERE {IMAGES})
"""


@query("manifest_photos", MANIFEST_CTE + """SELECT 'drive:' || id AS source_id, name, mimeType AS mime_type, CASE WHEN error IS NULL THEN CAST(size AS BIGINT) END AS byte_size,
  CASE WHEN error IS NULL THEN replace(modifiedTime, '.500Z', '.500000+00:00') END AS modified_at, CASE WHEN error IS NULL THEN 'gdrive://drive/files/' || id END AS raw_uri,
  CASE WHEN error IS NULL THEN '{"drive_created_time":' || coalesce('"' || createdTime || '"', 'null') || ',"drive_file_id":"' || id || '","drive_md5_checksum":' || coalesce('"' || md5Checksum || '"', 'null')
    || ',"drive_modified_time":"' || replace(modifiedTime, '.500Z', '.500000+00:00') || '","drive_parents":["folder' || listing || '"],"drive_version":"' || version || '","provider":"google_drive"}' END AS metadata_json, error FROM m""", views=("v_manifest",))
def manifest_photos(spark, d):
    return manifest.manifest_photos(listing_pages(spark, d), "drive").select(
        "source_id", "name", "mime_type", "byte_size", "modified_at", "raw_uri", "metadata_json", "error")


@query("manifest_page_check", """SELECT token AS "nextPageToken", CAST(count(*) AS BIGINT) AS n_pages, CASE WHEN token = '' THEN 'invalid' ELSE 'repeated' END AS problem
FROM (SELECT CASE WHEN page_id % 50 = 49 THEN '' WHEN page_id % 7 = 0 THEN 'again-' || page_id % 3 WHEN page_id % 11 <> 0 THEN 't' || page_id END AS token FROM pages) p
WHERE token IS NOT NULL GROUP BY token HAVING token = '' OR count(*) > 1""")
def manifest_page_check(spark, d):
    return manifest.page_problems(listing_pages(spark, d))


@query("sample_photos", MANIFEST_CTE + "SELECT 'drive:' || id AS source_id, mimeType AS mime_type FROM m WHERE error IS NULL ORDER BY mimeType <> 'image/jpeg', 'drive:' || id LIMIT 3", views=("v_manifest",))
def sample_photos(spark, d):
    good = manifest.manifest_photos(listing_pages(spark, d), "drive").filter("error IS NULL")
    return manifest.sample_photos(good, 3).select("source_id", "mime_type")


@query("manifest_verify", """SELECT CAST(page_id AS VARCHAR) AS source_id, CASE WHEN page_id % 5 = 4 THEN 'unsupported_hash_format' WHEN page_id % 5 = 0 THEN 'content_missing'
  WHEN page_id % 5 = 1 THEN 'byte_size_mismatch' WHEN page_id % 5 = 2 THEN 'content_hash_mismatch' ELSE 'ok' END AS verdict FROM pages""")
def manifest_verify(spark, d):
    pages, n = load(spark, d, "pages"), F.col("page_id")
    source_id = n.cast("string").alias("source_id")
    size = F.octet_length("html").cast("long")
    announced = pages.select(
        source_id, F.when(n % 5 == 1, size + 1).when(n % 2 == 0, size).alias("byte_size"),
        F.when(n % 5 == 4, "md5").when(n % 5 == 2, F.sha2("url", 256)).when(n % 3 == 0, F.upper(F.sha2("html", 256))).alias("content_hash"))
    arrived = pages.filter("page_id % 5 <> 0").select(source_id, F.encode("html", "UTF-8").alias("content"))
    return verify_manifest(announced, digest(arrived)).select("source_id", "verdict")


@query("folder_listing", """SELECT 'album:' || name AS source_id, name, byte_size, 'file:///photos/' || replace(name, ' ', '%20') AS raw_uri FROM (
SELECT 'IMG ' || page_id || CASE page_id % 3 WHEN 0 THEN '.JPG' ELSE '.jpeg' END AS name, CAST(length(html) AS BIGINT) AS byte_size, page_id FROM pages) t
WHERE page_id % 3 < 2 AND page_id % 7 <> 0 AND page_id % 11 <> 0""")
def folder_listing(spark, d):
    n = F.col("page_id")
    folder = F.when(n % 7 == 0, "file:/photos/deep/").when(n % 11 == 0, "file:/elsewhere/").otherwise("file:/photos/")
    name = F.concat(F.lit("IMG "), n.cast("string"), F.when(n % 3 == 0, ".JPG").when(n % 3 == 1, ".jpeg").otherwise(".png"))
    files = load(spark, d, "pages").select(
        F.concat(folder, name).alias("path"), F.char_length("html").cast("long").alias("length"),
        F.timestamp_micros(n * 1_000_000).alias("modificationTime"))
    return folders.list_photos(files, "/photos", "album").select("source_id", "name", "byte_size", "raw_uri")


LISTING_OUTCOMES = MANIFEST_CTE + f""", done AS (SELECT 'drive:' || id AS source_id, name, error, page_id, {object_id(DUCK, "'google_drive'", "('drive:' || id)")} AS object_id FROM m),
out AS (SELECT source_id, name AS filename, CASE WHEN error IS NULL THEN object_id END AS object_id, CASE WHEN error IS NULL THEN 'inserted' END AS ingestion_outcome,
  CASE WHEN error IS NULL THEN CASE page_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'failed' END END AS semantic_status, error FROM done)
"""


def listing_outcomes(spark, d):
    """Import of the good files of a listing, one extractor status each."""
    photos = manifest.manifest_photos(listing_pages(spark, d), "drive")
    good = photos.filter("error IS NULL")
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("long")
    items = good.select(
        number.alias("ordinal"), F.lit("photo").alias("object_type"), F.col("source_kind").alias("source"), "source_id", "raw_uri",
        F.encode("name", "UTF-8").alias("content"), F.lit(None).cast("string").alias("occurred_at"),
        F.lit("2024-06-01T00:00:00+00:00").alias("captured_at"), "mime_type", "metadata_json")
    stored, versions = load(spark, d, "v_stored"), load(spark, d, "v_stored_versions")
    outcomes = ingest(items, stored, versions).outcomes
    status = F.when(F.col("ordinal") % 3 == 0, "complete").when(F.col("ordinal") % 3 == 1, "unsupported").otherwise("failed")
    from keepsake.operators.extractors import status_rollup

    results = outcomes.select("object_id", F.explode(F.array(F.lit("complete"), status)).alias("status"))
    return import_outcomes(photos, outcomes, status_rollup(results, ["object_id"]))


@query("import_outcomes", LISTING_OUTCOMES + "SELECT * FROM out", views=("v_manifest",))
def listing_import(spark, d):
    return listing_outcomes(spark, d)


@query("batch_totals", LISTING_OUTCOMES + """SELECT count(*) AS n_items, count(*) FILTER (error IS NULL AND semantic_status <> 'failed') AS n_succeeded,
 count(*) FILTER (error IS NOT NULL OR semantic_status = 'failed') AS n_failed FROM out""", views=("v_manifest",))
def listing_totals(spark, d):
    return batch_totals(listing_outcomes(spark, d))


@query("snapshot_diff", OUTCOME_CTES + """, a AS (SELECT source, source_id, content_hash, metadata_json FROM v_items1),
b AS (SELECT source, source_id, arg_max(content_hash, ordinal) AS content_hash, arg_max(metadata_json, ordinal) AS metadata_json FROM v_items2 GROUP BY ALL)
SELECT source, source_id, CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (source, source_id) WHERE a.content_hash IS DISTINCT FROM b.content_hash OR a.metadata_json IS DISTINCT FROM b.metadata_json""", views=("v_items1", "v_items2", "v_stored"))
def snapshot_diff(spark, d):
    from keepsake.operators.hotkeys import latest

    before, after = load(spark, d, "v_items1"), load(spark, d, "v_items2")
    key, columns = ["source", "source_id"], ["content_hash", "metadata_json"]
    last = latest(after, key, F.col("ordinal"), columns)
    return quality.snapshot_diff(before, last, key, columns)
