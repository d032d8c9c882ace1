"""Input views: the given tables read as deliveries, tags, results, edges and queries.

Each view is one select in the common subset of Spark SQL and DuckDB. They only make
inputs; what is tested is written apart, with DataFrames on one side, SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialects import Duck, Spark, blob_id, object_id

PARENTS: dict[str, tuple[str, ...]] = {}
BUILDERS = {}


def view(*parents: str):
    def register(build):
        BUILDERS[build.__name__], PARENTS[build.__name__] = build, parents
        return build
    return register


def _ordered(names: tuple[str, ...]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for parent in PARENTS[name]:
            visit(parent)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def _ctes(dialect, names: tuple[str, ...]) -> str:
    return ",\n".join(f"{name} AS ({BUILDERS[name](dialect)})" for name in _ordered(names))


def duck_ctes(names: tuple[str, ...]) -> str:
    """``WITH …`` prefix for an oracle; continue with ``, more AS (…)`` or a select."""
    return f"WITH {_ctes(Duck(), names)}\n" if names else ""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table."""
    if name not in BUILDERS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spark.sql(f"WITH {_ctes(Spark(sf_dir), (name,))}\nSELECT * FROM {name}")


DOC_TYPE = (
    "CASE doc_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'note' ELSE 'message' END"
)
DOC_MIME = (
    "CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'audio/mpeg' ELSE 'text/plain' END"
)
DOC_TIME = (
    "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '-' || "
    "lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T10:20:30' || "
    "CASE WHEN doc_id % 3 = 0 THEN '+00:00' ELSE '+11:00' END END"
)
CAPTURED = "'2024-06-01T00:00:00+00:00'"
DOC_META = (
    "'{\"lang\":\"' || lang || '\",\"origin\":\"' || source || '\",\"size\":' || CAST(n_chars AS STRING) || '}'"
)


@view()
def v_items1(q):
    """First delivery: one item per document."""
    return f"""SELECT doc_id AS ordinal, {DOC_TYPE} AS object_type, 'documents' AS source,
  'doc-' || CAST(doc_id AS STRING) AS source_id,
  'file:///archive/' || source || '/' || CAST(doc_id AS STRING) || '.bin' AS raw_uri,
  {q.sha('text')} AS content_hash, {q.octets('text')} AS byte_size, {DOC_TIME} AS occurred_at,
  {CAPTURED} AS captured_at, {DOC_MIME} AS mime_type, {DOC_META} AS metadata_json
FROM {q.table('documents')}"""


@view()
def v_items2(q):
    """Second delivery: edits, absences, new ids, metadata changes, repeats in the batch."""
    return f"""SELECT doc_id * 2 + again AS ordinal, object_type, 'documents' AS source, source_id, raw_uri,
  {q.sha('body')} AS content_hash, {q.octets('body')} AS byte_size, occurred_at,
  '2024-07-01T00:00:00+00:00' AS captured_at, mime_type, metadata_json
FROM (SELECT doc_id, again, {DOC_TYPE} AS object_type,
    CASE WHEN doc_id % 10 = 2 THEN 'copy-' ELSE 'doc-' END || CAST(doc_id AS STRING) AS source_id,
    'file:///archive/' || source || '/' || CAST(doc_id AS STRING) || '.bin' AS raw_uri,
    CASE WHEN again = 1 AND doc_id % 14 = 0 THEN text || ' [again]'
         WHEN doc_id % 10 = 0 THEN text || ' [edited]' ELSE text END AS body,
    {DOC_TIME} AS occurred_at, {DOC_MIME} AS mime_type,
    CASE WHEN doc_id % 10 = 3 THEN '{{"note":"changed"}}' ELSE {DOC_META} END AS metadata_json
  FROM (SELECT *, CAST(0 AS BIGINT) AS again FROM {q.table('documents')}
        UNION ALL SELECT *, CAST(1 AS BIGINT) AS again FROM {q.table('documents')} WHERE doc_id % 7 = 0) d
  WHERE doc_id % 10 <> 1) e"""


@view("v_items1")
def v_stored(q):
    """Objects stored before the second delivery; some under another id."""
    return f"""SELECT CASE WHEN ordinal % 50 = 4 THEN 'kps_obj_0000' ELSE '' END || {object_id(q, 'source', 'source_id')} AS object_id,
  object_type, source, source_id, occurred_at, captured_at, CAST(NULL AS STRING) AS parent_id, raw_uri,
  content_hash, mime_type, CAST(NULL AS STRING) AS topic, metadata_json, captured_at AS created_at
FROM v_items1 WHERE ordinal % 13 <> 5"""


@view("v_stored")
def v_stored_versions(q):
    """One version per stored object, an older one for some."""
    return f"""SELECT object_id, content_hash, CAST(CASE WHEN source_id LIKE '%7' THEN 2 ELSE 1 END AS BIGINT) AS version,
  object_type, occurred_at, captured_at, parent_id, raw_uri, mime_type, metadata_json FROM v_stored
UNION ALL SELECT object_id, {q.sha("'old ' || source_id")} AS content_hash, CAST(1 AS BIGINT) AS version,
  object_type, occurred_at, captured_at, parent_id, raw_uri, mime_type, metadata_json FROM v_stored WHERE source_id LIKE '%7'"""


@view("v_items1")
def v_objects(q):
    """The object table of the searchable archive."""
    return f"""SELECT {object_id(q, 'source', 'source_id')} AS object_id, object_type, source, source_id, occurred_at,
  captured_at, CAST(NULL AS STRING) AS parent_id, raw_uri, content_hash, mime_type, CAST(NULL AS STRING) AS topic,
  CAST(NULL AS STRING) AS event_id, CAST(NULL AS DOUBLE) AS confidence, metadata_json, captured_at AS created_at,
  ordinal AS doc_id
FROM v_items1"""


@view("v_objects")
def v_attachments(q):
    return f"""SELECT object_id, {blob_id('content_hash')} AS blob_id, created_at, doc_id
FROM v_objects WHERE object_type IN ('photo', 'video', 'audio')"""


@view("v_items1")
def v_blobs(q):
    return f"""SELECT {blob_id('content_hash')} AS blob_id, content_hash AS sha256, max(byte_size) AS byte_size,
  min(mime_type) AS mime_type, min(captured_at) AS created_at
FROM v_items1 WHERE object_type IN ('photo', 'video', 'audio') GROUP BY content_hash"""


LABEL = (
    "CASE doc_id % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'Street sign' WHEN 2 THEN 'car' WHEN 3 THEN 'Snow  board' "
    "WHEN 4 THEN 'bicycle' WHEN 5 THEN 'sea gull' ELSE 'swimming trunks' END"
)
LABEL_SLUG = (
    "CASE doc_id % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'street-sign' WHEN 2 THEN 'car' WHEN 3 THEN 'snow-board' "
    "WHEN 4 THEN 'bicycle' WHEN 5 THEN 'sea-gull' ELSE 'swimming-trunks' END"
)
LATITUDE = "(48 + CAST(doc_id % 8 AS DOUBLE) / 8)"
LONGITUDE = "(142 + CAST(doc_id % 4 AS DOUBLE) / 4)"


@view("v_objects", "v_attachments")
def v_results(q):
    """Extractor results: text or caption for all, detections and places for photos."""
    base = f"""SELECT o.object_id, o.object_type, o.content_hash, a.blob_id, d.doc_id, d.text, l.quality, r.kind
FROM {q.table('documents')} d JOIN v_objects o ON o.doc_id = d.doc_id
LEFT JOIN v_attachments a ON a.doc_id = d.doc_id LEFT JOIN {q.table('labels')} l ON l.doc_id = d.doc_id
CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 AS kind UNION ALL SELECT 2 AS kind) r
WHERE r.kind = 0 OR (d.doc_id % 5 = 0 AND r.kind = 1) OR (d.doc_id % 15 = 0 AND r.kind = 2)"""
    return f"""SELECT 'kps_sem_' || {q.uuid("('semantic:' || object_id || ':' || extractor_name || ':1.0.0:' || semantic_type || ':' || content_hash || ':' || coalesce(blob_id, ''))")} AS semantic_result_id,
  object_id, blob_id AS source_blob_id, content_hash AS source_content_hash, extractor_name, '1.0.0' AS extractor_version,
  semantic_type, status, confidence, result_json, result_text, '[]' AS diagnostics_json, '{{}}' AS provenance_json,
  doc_id % 19 <> 0 AS is_current, '2024-06-02T00:00:00+00:00' AS created_at, doc_id, kind
FROM (SELECT object_id, object_type, content_hash, blob_id, doc_id, kind,
  CASE kind WHEN 1 THEN 'photo.objects' WHEN 2 THEN 'photo.place' ELSE CASE WHEN object_type = 'photo' THEN 'photo.caption' ELSE 'text_normalization' END END AS extractor_name,
  CASE kind WHEN 1 THEN 'detected_objects' WHEN 2 THEN 'detected_places' ELSE CASE WHEN object_type = 'photo' THEN 'image_caption' ELSE 'text_normalization' END END AS semantic_type,
  CASE WHEN kind = 0 AND doc_id % 11 = 0 THEN 'failed' WHEN kind = 0 AND doc_id % 17 = 0 THEN 'unsupported' WHEN doc_id % 6 = 0 THEN 'partial' ELSE 'complete' END AS status,
  CASE kind WHEN 1 THEN CAST(doc_id % 10 AS DOUBLE) / 10 WHEN 2 THEN CAST(1 AS DOUBLE) ELSE CASE quality WHEN 1 THEN CAST(0.875 AS DOUBLE) WHEN 0 THEN CAST(0.375 AS DOUBLE) ELSE NULL END END AS confidence,
  CASE kind WHEN 1 THEN '{{"detections":[{{"label":"' || {LABEL} || '"}},{{"label":"tree"}}],"task":"<OD>"}}'
    WHEN 2 THEN '{{"candidates":[{{"confidence":0.5,"kind":"gps_coordinate","latitude":' || CAST({LATITUDE} AS STRING) || ',"longitude":' || CAST({LONGITUDE} AS STRING) || '}}]}}'
    ELSE NULL END AS result_json,
  CASE WHEN kind = 0 THEN text ELSE NULL END AS result_text
FROM ({base}) b) c"""


@view("v_results")
def v_semantic_relations(q):
    """Base relation of each result, mentions of detections and places."""
    rows = f"""SELECT object_id, semantic_result_id, 'object_has_semantic_result' AS relation_type, semantic_result_id AS target_ref, confidence FROM v_results
UNION ALL SELECT object_id, semantic_result_id, 'semantic_mentions_entity' AS relation_type, 'object:' || {LABEL_SLUG} AS target_ref, confidence FROM v_results WHERE kind = 1
UNION ALL SELECT object_id, semantic_result_id, 'semantic_mentions_place' AS relation_type, 'geo:harbour-' || CAST(doc_id % 9 AS STRING) AS target_ref, CAST(1 AS DOUBLE) AS confidence FROM v_results WHERE kind = 2"""
    return f"""SELECT 'kps_semrel_' || {q.uuid("('semantic-relation:' || semantic_result_id || ':' || relation_type || ':' || target_ref)")} AS semantic_relation_id,
  object_id, semantic_result_id, relation_type, target_ref, confidence, '2024-06-02T00:00:00+00:00' AS created_at FROM ({rows}) r"""


@view("v_objects", "v_attachments")
def v_extractions(q):
    """Metadata extractions of photos and videos, two generations for some."""
    return f"""SELECT 'kps_meta_' || {q.uuid("('metadata:' || o.object_id || ':' || a.blob_id || ':tags@' || CAST(g.gen AS STRING))")} AS extraction_id,
  o.object_id, a.blob_id, 'tags@' || CAST(g.gen AS STRING) AS extractor_id,
  CASE WHEN o.doc_id % 35 = 0 THEN 'failed' WHEN o.doc_id % 3 = 0 THEN 'complete' ELSE 'partial' END AS status,
  '{{"camera":{{"make":' || CASE WHEN o.doc_id % 2 = 0 THEN '"Acme"' ELSE 'null' END || ',"model":null}},"city":"North Bay ' || CAST(o.doc_id % 6 AS STRING)
    || '","gps":' || CASE WHEN o.doc_id % 4 < 2 THEN '{{"latitude":' || CAST(48 + CAST(o.doc_id % 8 AS DOUBLE) / 8 AS STRING) || ',"longitude":' || CAST(142 + CAST(o.doc_id % 4 AS DOUBLE) / 4 AS STRING) || '}}' ELSE 'null' END
    || ',"generation":' || CAST(g.gen AS STRING) || ',"orientation":' || CASE WHEN o.doc_id % 3 = 1 THEN '6' ELSE 'null' END || '}}' AS metadata_json,
  CAST(NULL AS STRING) AS occurred_at, CAST(NULL AS STRING) AS occurred_at_source, 'none' AS occurred_at_confidence,
  '2024-06-0' || CAST(g.gen AS STRING) || 'T00:00:00+00:00' AS extracted_at, o.doc_id
FROM v_objects o JOIN v_attachments a ON a.object_id = o.object_id
CROSS JOIN (SELECT 1 AS gen UNION ALL SELECT 2 AS gen) g
WHERE o.object_type IN ('photo', 'video') AND (g.gen = 1 OR o.doc_id % 2 = 0)"""


@view("v_extractions")
def v_metadata_diagnostics(q):
    """Diagnostic rows of the extractions."""
    return f"""SELECT extraction_id, CASE WHEN code LIKE '%.extraction_failed' THEN 'error' ELSE 'warning' END AS severity, code,
  CASE WHEN code LIKE '%.extraction_failed' THEN CASE WHEN doc_id % 2 = 0 THEN 'OSError: unreadable' ELSE 'broken: file' END ELSE 'detail of ' || code END AS detail,
  extracted_at AS created_at FROM (
SELECT extraction_id, doc_id, extracted_at, 'photo.extraction_failed' AS code FROM v_extractions WHERE status = 'failed'
UNION ALL SELECT extraction_id, doc_id, extracted_at, 'photo.gps_missing' AS code FROM v_extractions WHERE doc_id % 4 >= 2
UNION ALL SELECT extraction_id, doc_id, extracted_at, 'photo.gps_invalid' AS code FROM v_extractions WHERE doc_id % 4 = 1 AND status = 'partial'
UNION ALL SELECT extraction_id, doc_id, extracted_at, 'photo.capture_time_conflict' AS code FROM v_extractions WHERE doc_id % 10 = 5
UNION ALL SELECT extraction_id, doc_id, extracted_at, 'photo.timezone_missing' AS code FROM v_extractions WHERE doc_id % 10 = 0 AND status = 'partial') x"""


@view("v_objects")
def v_edges(q):
    """Object relations: each third object points at the next one, some at themselves."""
    return f"""SELECT 'kps_rel_' || {q.uuid("('relation:' || a.kind || ':' || a.object_id || ':' || b.object_id)")} AS relation_id,
  a.object_id AS from_object_id, b.object_id AS to_object_id, a.kind AS relation_type,
  CASE WHEN a.doc_id % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE NULL END AS confidence, 'importer' AS model_id, a.created_at
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'near_snow' ELSE 'follows' END AS kind, doc_id + CASE WHEN doc_id % 21 = 0 THEN 0 ELSE 1 END AS other FROM v_objects WHERE doc_id % 3 = 0) a
JOIN v_objects b ON b.doc_id = a.other"""


@view()
def v_queries(q):
    """Queries out of the benchmark texts, with concepts, filters and limits."""
    head = "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)"
    return f"""SELECT item_id AS query_id, {head} || CASE item_id % 5 WHEN 0 THEN ' person on snow' WHEN 1 THEN ' with signboard'
    WHEN 2 THEN ' license' WHEN 3 THEN ' bathing suit and cars' ELSE '' END AS query,
  CASE item_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'note' END AS media_type,
  CASE WHEN item_id % 4 = 1 THEN '2024-02-10T00:00:00Z' END AS time_from,
  CASE WHEN item_id % 8 = 1 THEN '2024-10-10T00:00:00+02:00' END AS time_to,
  CASE WHEN item_id % 7 = 3 THEN 'the North bay' WHEN item_id % 7 = 4 THEN 'harbour' END AS place,
  CASE WHEN item_id % 6 = 0 THEN 3 ELSE 10 END AS k
FROM {q.table('benchmark')}"""


@view()
def v_exif(q):
    """Tag records out of events: conflicts, missing and bad offsets, coordinates of all kinds."""
    stamp = f"replace(replace({q.iso('ts')}, '-', ':'), 'T', ' ')"
    return f"""SELECT event_id, CAST(event_id AS STRING) AS object_id, event_id % 17 <> 0 AS has_exif,
  CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '2024:13:45 99:00:00' ELSE {stamp} END AS date_time_original,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '2020:01:01 00:00:00' ELSE {stamp} END AS date_time_digitized,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '+25:00' WHEN event_id % 2 = 0 THEN '+11:00' ELSE ' -03:30 ' END AS offset_time,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Acme ' || event_type END AS make,
  CASE WHEN event_id % 6 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN NULL ELSE 'M' || CAST(user_id % 10 AS STRING) END AS model,
  CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 8 + 1 END AS INT) AS orientation,
  CAST(640 + event_id % 100 AS INT) AS width, CAST(480 + event_id % 50 AS INT) AS height,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CASE WHEN event_id % 8 = 1 THEN 'S' ELSE 'N' END END AS lat_ref,
  CAST(user_id % 100 AS DOUBLE) AS lat_d, CAST(event_id % 60 AS DOUBLE) AS lat_m, value AS lat_s,
  CASE WHEN event_id % 8 < 3 THEN 'W' ELSE 'E' END AS lon_ref,
  CAST(user_id AS DOUBLE) AS lon_d, CAST(event_id % 59 AS DOUBLE) AS lon_m, value / 2 AS lon_s,
  event_id % 29 = 0 AS short_gps
FROM {q.table('events')}"""


@view()
def v_tracks(q):
    """Track fields out of events: date spellings, durations, ISO 6709 text."""
    return f"""SELECT event_id, CAST(event_id AS STRING) AS object_id,
  CASE event_id % 6 WHEN 0 THEN 'UTC ' || replace({q.iso('ts')}, 'T', ' ') WHEN 1 THEN replace({q.iso('ts')}, 'T', ' ') || ' UTC'
    WHEN 2 THEN {q.iso('ts')} || 'Z' WHEN 3 THEN replace({q.iso('ts')}, 'T', ' ') WHEN 4 THEN {q.iso('ts')} || '+11:00' ELSE NULL END AS encoded_date,
  CASE WHEN event_id % 12 = 0 THEN 'UTC 2020-02-02 02:02:02' WHEN event_id % 12 = 1 THEN replace({q.iso('ts')}, 'T', ' ') || '.250 UTC' WHEN event_id % 12 = 5 THEN ' ' END AS tagged_date,
  CASE WHEN event_id % 15 = 0 THEN 'n/a' WHEN event_id % 16 = 0 THEN NULL ELSE CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING) END AS duration,
  CASE event_id % 5 WHEN 0 THEN '+48.5000+142.7500/' WHEN 1 THEN '+99.0-10.5/' WHEN 2 THEN '-33.25-070.5+520/' WHEN 3 THEN 'unknown' ELSE NULL END AS location,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'AVC' END AS format,
  CASE WHEN event_id % 31 = 0 THEN '19x20' WHEN event_id % 10 = 0 THEN '' ELSE CAST(1280 + event_id % 640 AS STRING) END AS width,
  event_id % 25 = 3 AS no_video
FROM {q.table('events')}"""


@view()
def v_boxes(q):
    """Model output per line item: three labels with boxes and scores, some missing."""
    return f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS image_id,
  CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN ' Street   sign ' ELSE 'bicycle' END AS label_a,
  CASE l_linestatus WHEN 'O' THEN 'person' ELSE '  ' END AS label_b,
  CASE WHEN l_quantity > 25 THEN 'Снег 7' ELSE 'red-car' END AS label_c,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 10 END AS score_a, l_tax * 10 AS score_b,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_discount END AS score_c,
  l_quantity * 1.23456 AS x, l_quantity * 2.5 AS y, l_quantity * 3.1 AS x2, l_quantity * 4.75 AS y2,
  CAST(64 + l_linenumber AS INT) AS width, CAST(48 + l_linenumber AS INT) AS height
FROM {q.table('lineitem')}"""


@view()
def v_manifest(q):
    """Files of provider listings out of pages: types, sizes and times good and bad."""
    return f"""SELECT page_id, CASE WHEN page_id % 41 = 0 THEN 'bad id' ELSE 'file' || CAST(page_id AS STRING) END AS id,
  CASE WHEN page_id % 43 = 0 THEN '' ELSE 'img-' || CAST(page_id AS STRING) || '.jpg' END AS name,
  CASE page_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/heic' ELSE 'video/mp4' END AS mimeType,
  CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 23 = 0 THEN '-5' WHEN page_id % 29 = 0 THEN 'big' ELSE CAST(length(html) AS STRING) END AS size,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'md5-' || CAST(page_id AS STRING) END AS md5Checksum,
  CASE WHEN page_id % 13 = 0 THEN '2024-05-05T01:02:03' WHEN page_id % 31 = 0 THEN 'yesterday' WHEN page_id % 37 = 0 THEN NULL
    ELSE '2024-05-' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0') || 'T01:02:03.500Z' END AS modifiedTime,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2023-01-02T03:04:05+02:00' END AS createdTime,
  CAST(page_id % 5 + 1 AS STRING) AS version, page_id % 19 = 0 AS trashed,
  CAST(floor(page_id / 10) AS BIGINT) AS listing
FROM {q.table('pages')}"""


@view()
def v_audit(q):
    """Requests out of events: principal, time, endpoint."""
    return f"""SELECT event_id AS request_id, CAST(user_id AS STRING) AS principal, {q.micros('ts')} AS stamp, event_type AS endpoint, value
FROM {q.table('events')}"""


@view()
def v_conv_nodes(q):
    """Conversation nodes: a turn hangs on the turn before, each seventh on a key that does not exist."""
    return f"""SELECT conv_id, turn, role, text, CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) AS node_id,
  CASE WHEN turn = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN 'gone' ELSE CAST(conv_id AS STRING) || '.' || CAST(turn - 1 AS STRING) END AS parent_key
FROM {q.table('conversations')}"""


@view()
def v_exports(q):
    """One export document per turn, in twelve shapes (``v``): roots, missing ids, odd mappings, odd messages.

    JSON is written with sorted keys, so that its canonical form is itself.
    """
    return f"""SELECT *, CASE v WHEN 0 THEN '{{"conversations":[' || conv_json || ']}}' WHEN 1 THEN '[5,' || conv_json || ']' ELSE '[' || conv_json || ']' END AS body FROM (
SELECT *, CASE v WHEN 2 THEN '{{' WHEN 10 THEN '{{' ELSE '{{"conversation_id":"' || cid || '",' END || '"create_time":1700000000.5' || CASE v WHEN 10 THEN ',"id":' || cid ELSE '' END
  || ',"mapping":' || CASE v WHEN 3 THEN '["x"]' WHEN 9 THEN 'null' ELSE '{{' || CASE v WHEN 4 THEN '"bad":7,' ELSE '' END || '"m":' || node_json || ',"root":' || root_json || '}}' END || '}}' AS conv_json
FROM (SELECT *, '{{"message":' || message_json || ',"parent":"' || CASE v WHEN 8 THEN 'gone' ELSE 'root' END || '"}}' AS node_json,
  '{{"children":["m"],"message":null,"parent":null}}' AS root_json
FROM (SELECT *, '{{"author":{{"role":"' || role || '"}},"content":{{"content_type":"' || CASE v WHEN 6 THEN 'thoughts' ELSE 'text' END || '","parts":[' || {q.json_string('text')} || ']}},"create_time":'
  || CAST(1700000000 + turn AS STRING) || CASE v WHEN 5 THEN '' ELSE ',"id":"' || mid || '"' END || CASE v WHEN 7 THEN ',"metadata":{{"attachments":[{{"id":"a"}}]}}' ELSE '' END || '}}' AS message_json
FROM (SELECT *, conv_id * 64 + turn AS doc_id, (conv_id + turn) % 12 AS v,
  CASE (conv_id + turn) % 12 WHEN 10 THEN CAST(conv_id * 1000 + turn AS STRING) ELSE 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) END AS cid,
  'msg-' || CAST(conv_id AS STRING) || '-' || CAST(CASE WHEN conv_id % 5 = 0 THEN turn - turn % 2 ELSE turn END AS STRING) AS mid
  FROM {q.table('conversations')}) a) b) c) e"""


@view("v_exports")
def v_conv_stored(q):
    """Messages of earlier imports: a third the same, a third different, a third not there."""
    return f"""SELECT {object_id(q, "'chatgpt.message'", 'mid')} AS object_id, 'chatgpt_message_user' AS object_type, 'chatgpt.message' AS source, mid AS source_id,
  max(CASE WHEN conv_id % 3 = 0 THEN {q.sha('message_json')} ELSE {q.sha("'older'")} END) AS content_hash
FROM v_exports WHERE conv_id % 3 < 2 AND conv_id % 5 <> 0 AND v NOT IN (2, 3, 5, 9) GROUP BY mid"""


@view("v_exports")
def v_conv_relations(q):
    """Parent edges of earlier imports, present and stale."""
    node = lambda key: object_id(q, "'chatgpt.node'", f"(cid || '/{key}')")
    rows = f"""SELECT 'node_parent' AS relation_type, {node('root')} AS from_object_id, {node('m')} AS to_object_id FROM v_exports WHERE conv_id % 2 = 0 AND v NOT IN (2, 3, 9)
UNION ALL SELECT 'node_parent' AS relation_type, {node('old')} AS from_object_id, {node('m')} AS to_object_id FROM v_exports WHERE conv_id % 7 = 0 AND v NOT IN (2, 3, 9)"""
    return f"""SELECT 'kps_rel_' || {q.uuid("('relation:node_parent:' || from_object_id || ':' || to_object_id)")} AS relation_id, relation_type, from_object_id, to_object_id FROM ({rows}) r"""
