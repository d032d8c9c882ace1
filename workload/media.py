"""Photo and video metadata, its projection, diagnostics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import metadata

from .fragments import DUCK, clean
from .registry import query
from .views import load


def exif_records(spark, d):
    """Tag records in the shape the normaliser takes."""
    rows = load(spark, d, "v_exif")
    dms = lambda side: F.when(F.col("short_gps"), F.array(f"{side}_d", f"{side}_m")).otherwise(F.array(f"{side}_d", f"{side}_m", f"{side}_s"))
    gps = F.when(F.col("lat_ref").isNotNull(), F.struct("lat_ref", dms("lat").alias("lat"), "lon_ref", dms("lon").alias("lon")))
    return rows.select("event_id", "object_id", "has_exif", "date_time_original", "date_time_digitized", "offset_time",
                       "make", "model", "orientation", "width", "height", gps.alias("gps"))


def track_records(spark, d):
    """Track maps in the shape the normaliser takes."""
    rows = load(spark, d, "v_tracks")
    general = F.map_filter(F.create_map(
        F.lit("encoded_date"), "encoded_date", F.lit("tagged_date"), "tagged_date", F.lit("duration"), "duration",
        F.lit("Recorded_Location"), "location", F.lit("format"), F.lit("MPEG-4")), lambda _, value: value.isNotNull())
    video = F.when(F.col("no_video"), F.create_map().cast("map<string,string>")).otherwise(F.map_filter(
        F.create_map(F.lit("format"), "format", F.lit("width"), "width", F.lit("height"), F.lit("720")),
        lambda _, value: value.isNotNull()))
    return rows.select("event_id", "object_id", general.alias("general"), video.alias("video"))


EXIF_CTES = f""", e AS (SELECT *, {clean('date_time_original')} AS o, {clean('date_time_digitized')} AS g, {clean('offset_time')} AS z, {clean('make')} AS mk, {clean('model')} AS md,
  CASE WHEN short_gps OR lat_ref IS NULL THEN NULL ELSE round((lat_d + lat_m / 60 + lat_s / 3600) * CASE WHEN lat_ref = 'S' THEN -1 ELSE 1 END, 8) END AS la,
  CASE WHEN short_gps OR lat_ref IS NULL THEN NULL ELSE round((lon_d + lon_m / 60 + lon_s / 3600) * CASE WHEN lon_ref = 'W' THEN -1 ELSE 1 END, 8) END AS lo FROM v_exif),
f AS (SELECT *, coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false) AS gps_ok, coalesce(o <> g, false) AS clash,
  strftime(try_strptime(o, '%Y:%m:%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS local FROM e),
photo AS (SELECT *, CASE WHEN NOT clash AND z <> '+25:00' THEN local || z END AS moment,
  list_filter([CASE WHEN lat_ref IS NOT NULL AND NOT gps_ok THEN 'photo.gps_invalid' END, CASE WHEN lat_ref IS NULL THEN 'photo.gps_missing' END,
    CASE WHEN NOT has_exif THEN 'photo.exif_missing' END, CASE WHEN clash THEN 'photo.capture_time_conflict' END,
    CASE WHEN o IS NOT NULL AND z IS NOT NULL AND NOT clash AND (local IS NULL OR z = '+25:00') THEN 'photo.capture_time_invalid' END,
    CASE WHEN o IS NOT NULL AND z IS NULL AND NOT clash THEN 'photo.timezone_missing' END, CASE WHEN o IS NULL THEN 'photo.capture_time_missing' END,
    CASE WHEN mk IS NULL AND md IS NULL THEN 'photo.camera_missing' END], lambda x: x IS NOT NULL) AS codes FROM f)
"""


@query("photo_metadata", EXIF_CTES + """SELECT event_id, CASE WHEN gps_ok THEN la END AS latitude, CASE WHEN gps_ok THEN lo END AS longitude, moment AS occurred_at,
 CASE WHEN len(codes) > 0 THEN 'partial' ELSE 'complete' END AS status, array_to_string(codes, ',') AS codes, mk AS make, md AS model, orientation FROM photo""", views=("v_exif",))
def photo_metadata(spark, d):
    done = metadata.photo_metadata(exif_records(spark, d))
    field = lambda path: F.get_json_object("metadata_json", path)
    return done.select("event_id", "latitude", "longitude", "occurred_at", "status", F.array_join(F.col("diagnostics")["code"], ",").alias("codes"),
                       field("$.camera.make").alias("make"), field("$.camera.model").alias("model"), field("$.orientation").cast("int").alias("orientation"))


def duck_date(x: str) -> str:
    """The spellings of the track view, case by case."""
    return (
        f"CASE WHEN {x} LIKE 'UTC %' THEN strftime(strptime({x}[5:], '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') || '+00:00' "
        f"WHEN {x} LIKE '%.250 UTC' THEN replace({x}[:19], ' ', 'T') || '.250000+00:00' "
        f"WHEN {x} LIKE '% UTC' THEN replace({x}[:19], ' ', 'T') || '+00:00' WHEN {x} LIKE '%Z' THEN replace({x}, 'Z', '+00:00') "
        f"WHEN {x} LIKE '%+11:00' THEN {x} END"
    )


TRACK_CTES = f""", t AS (SELECT *, {duck_date('encoded_date')} AS a, {duck_date('tagged_date')} AS b, {clean('encoded_date')} AS ra, {clean('tagged_date')} AS rb,
  CASE event_id % 5 WHEN 0 THEN 48.5 WHEN 2 THEN -33.25 END::DOUBLE AS la, CASE event_id % 5 WHEN 0 THEN 142.75 WHEN 2 THEN -70.5 END::DOUBLE AS lo,
  try_cast(duration AS DOUBLE) / 1000 AS secs, coalesce(width = '19x20', false) AND NOT no_video AS broken FROM v_tracks),
video AS (SELECT *, CASE WHEN broken THEN ['video.extraction_failed'] ELSE list_filter([
    CASE WHEN a <> b THEN 'video.creation_time_conflict' END, CASE WHEN a IS NULL AND b IS NULL AND (ra IS NOT NULL OR rb IS NOT NULL) THEN 'video.creation_timezone_missing' END,
    CASE WHEN ra IS NULL AND rb IS NULL THEN 'video.creation_time_missing' END, CASE WHEN la IS NULL THEN 'video.gps_missing' END,
    CASE WHEN no_video THEN 'video.track_missing' END, CASE WHEN duration IS NOT NULL AND secs IS NULL THEN 'video.duration_invalid' END], lambda x: x IS NOT NULL) END AS codes,
  CASE WHEN NOT broken AND coalesce(a = b, true) THEN coalesce(a, b) END AS moment FROM t)
"""


@query("video_metadata", TRACK_CTES + """SELECT event_id, CASE WHEN NOT broken THEN la END AS latitude, CASE WHEN NOT broken THEN lo END AS longitude, CASE WHEN NOT broken THEN secs END AS duration_seconds,
 CASE WHEN NOT broken AND NOT no_video THEN try_cast(nullif(width, '') AS INT) END AS width, moment AS occurred_at,
 CASE WHEN moment IS NOT NULL THEN CASE WHEN a IS NOT NULL THEN 'mediainfo.encoded_date' ELSE 'mediainfo.tagged_date' END END AS occurred_at_source,
 CASE WHEN broken THEN 'failed' WHEN len(codes) > 0 THEN 'partial' ELSE 'complete' END AS status, array_to_string(codes, ',') AS codes FROM video""", views=("v_tracks",))
def video_metadata(spark, d):
    return metadata.video_metadata(track_records(spark, d)).select(
        "event_id", "latitude", "longitude", "duration_seconds", "width", "occurred_at", "occurred_at_source", "status",
        F.array_join(F.col("diagnostics")["code"], ",").alias("codes"))


@query("metadata_targets", "SELECT o.object_id, a.blob_id FROM v_objects o JOIN v_attachments a ON a.object_id = o.object_id WHERE object_type IN ('photo', 'video')", views=("v_objects", "v_attachments"))
def metadata_targets(spark, d):
    return metadata.metadata_targets(load(spark, d, "v_objects").drop("doc_id"), load(spark, d, "v_attachments")).select("object_id", "blob_id")


def projected(spark, d):
    """Projection of tag records onto targets: some known times agree, some do not, some are stored already."""
    normalised = metadata.photo_metadata(exif_records(spark, d))
    n = F.col("event_id")
    known = F.when(n % 6 == 1, F.lit("2000-01-01T00:00:00+00:00")).when(n % 6 == 2, F.col("occurred_at"))
    targets = normalised.select("object_id", F.concat(F.lit("blob-"), "object_id").alias("blob_id"), F.lit("h").alias("content_hash"), known.alias("occurred_at"), "event_id")
    from keepsake.functions.ids import DEFAULT_IDS

    stored = targets.filter("event_id % 10 = 7").select(
        DEFAULT_IDS.extraction_id(F.col("object_id"), F.col("blob_id"), F.lit(metadata.PHOTO_EXTRACTOR)).alias("extraction_id"))
    return metadata.project_metadata(targets, normalised.drop("event_id"), stored)


PROJECTED = EXIF_CTES + f""", pr AS (SELECT *, event_id % 6 = 1 AND moment IS NOT NULL AS dropped,
  'kps_meta_' || {DUCK.uuid("('metadata:' || object_id || ':blob-' || object_id || ':photo.tags@1')")} AS extraction_id FROM photo WHERE event_id % 10 <> 7)
"""


@query("metadata_projection", PROJECTED + """SELECT extraction_id, object_id, CASE WHEN dropped OR len(codes) > 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN NOT dropped THEN moment END AS occurred_at,
 CASE WHEN moment IS NOT NULL AND NOT dropped THEN 'high' ELSE 'none' END AS occurred_at_confidence, moment IS NOT NULL AND event_id % 6 NOT IN (1, 2) AS backfill FROM pr""", views=("v_exif",))
def metadata_projection(spark, d):
    return projected(spark, d).select("extraction_id", "object_id", "status", "occurred_at", "occurred_at_confidence", "backfill")


@query("version_backfill", PROJECTED + """, filled AS (SELECT event_id, object_id, CASE WHEN event_id % 10 <> 7 AND moment IS NOT NULL AND event_id % 6 NOT IN (1, 2) THEN moment END AS derived FROM photo)
SELECT object_id, CAST(v AS BIGINT) AS version, CASE WHEN v = 2 THEN CASE WHEN event_id % 4 = 0 THEN '1999-01-01T00:00:00+00:00' ELSE derived END END AS occurred_at
FROM filled CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2) x""", views=("v_exif",))
def version_backfill(spark, d):
    n = F.col("event_id")
    photos = metadata.photo_metadata(exif_records(spark, d)).select("object_id", "event_id")
    versions = photos.select("object_id", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).select(
        "object_id", F.col("v").cast("bigint").alias("version"), F.when(F.col("v") == 2, "h").otherwise("older").alias("content_hash"),
        F.when((F.col("v") == 2) & (n % 4 == 0), "1999-01-01T00:00:00+00:00").alias("occurred_at"))
    return metadata.backfill_versions(versions, projected(spark, d)).select("object_id", "version", "occurred_at")


@query("metadata_diagnostics", PROJECTED + """SELECT extraction_id, 'warning' AS severity, unnest(CASE WHEN dropped THEN list_append(codes, 'canonical.occurred_at_conflict') ELSE codes END) AS code FROM pr""", views=("v_exif",))
def metadata_diagnostics(spark, d):
    return metadata.metadata_diagnostics(projected(spark, d)).select("extraction_id", "severity", "code")


@query("latest_metadata", "SELECT object_id, extraction_id, extractor_id, status FROM v_extractions QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY extracted_at DESC, extraction_id DESC) = 1", views=("v_extractions",))
def latest_metadata(spark, d):
    return metadata.latest_metadata(load(spark, d, "v_extractions").drop("doc_id")).select("object_id", "extraction_id", "extractor_id", "status")


def duck_group(group: str, found: str, extra: str = "") -> str:
    return (
        f"CASE WHEN extraction_id IS NULL THEN NULL WHEN list_contains(codes, 'photo.extraction_failed') THEN 'error' "
        f"WHEN list_contains(codes, 'photo.{group}_conflict') THEN 'conflict' WHEN list_contains(codes, 'photo.{group}_invalid') THEN 'invalid' "
        f"WHEN list_contains(codes, 'photo.{group}_missing') THEN 'missing' {extra} WHEN {found} THEN 'found' ELSE 'missing' END AS {group}_status"
    )


@query("diagnostic_summary", f""", ls AS (SELECT * FROM v_extractions QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY extracted_at DESC, extraction_id DESC) = 1),
dg AS (SELECT extraction_id, list_sort(list(DISTINCT code)) AS codes, min(CASE WHEN code LIKE '%.extraction_failed' THEN detail END) AS failure FROM v_metadata_diagnostics GROUP BY extraction_id),
j AS (SELECT o.object_id, ls.extraction_id, ls.extractor_id, ls.status, ls.metadata_json, coalesce(dg.codes, []) AS codes, failure FROM v_objects o LEFT JOIN ls ON ls.object_id = o.object_id LEFT JOIN dg ON dg.extraction_id = ls.extraction_id)
SELECT object_id, extractor_id AS extractor, coalesce(status, 'missing') AS status,
  CASE WHEN list_contains(codes, 'photo.extraction_failed') THEN 'extractor_error' WHEN status = 'partial' THEN CASE WHEN len(codes) > 0 AND len(list_filter(codes, lambda c: c LIKE '%_invalid' OR c LIKE '%_conflict')) = 0 THEN 'missing_optional_metadata' ELSE 'metadata_quality_issue' END END AS error_category,
  CASE WHEN split_part(failure, ':', 1) = 'OSError' THEN 'OSError' END AS error_type,
  {duck_group('capture_time', 'false', "WHEN list_contains(codes, 'photo.timezone_missing') THEN 'partial'")},
  {duck_group('gps', "json_extract_string(metadata_json, '$.gps') IS NOT NULL")}, {duck_group('camera', "json_extract_string(metadata_json, '$.camera.make') IS NOT NULL")},
  {duck_group('orientation', "json_extract_string(metadata_json, '$.orientation') IS NOT NULL")}, {duck_group('dimensions', 'false')},
  CASE WHEN extraction_id IS NOT NULL THEN array_to_string(codes, ',') END AS codes FROM j""", views=("v_extractions", "v_metadata_diagnostics"))
def diagnostic_summary(spark, d):
    return metadata.diagnostic_summary(load(spark, d, "v_objects"), load(spark, d, "v_extractions").drop("doc_id"), load(spark, d, "v_metadata_diagnostics"))
