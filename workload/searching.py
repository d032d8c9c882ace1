"""Evidence search, public views, object records and media details."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import shared_dir
from keepsake.functions.ids import DEFAULT_IDS
from keepsake.operators import compact, search
from keepsake.sources.tables import read_archive, read_index, write_index, write_snapshot

from .fragments import CONCEPT_CTES, collapse, found_in, norm, toks
from .registry import query
from .views import load

TABLES = ("v_objects", "v_attachments", "v_results", "v_semantic_relations", "v_extractions", "v_edges")
SEARCH_VIEWS = (*TABLES, "v_queries")


_WRITTEN: dict[tuple[str, str], str] = {}
_INDEXED: set[str] = set()


NAMES = ("objects", "attachments", "semantic_results", "semantic_relations", "metadata_extractions", "relations")


def index_tables(spark, d):
    """The tables of the searchable archive, made from the given data."""
    return {name: load(spark, d, view).drop("doc_id", "kind") for name, view in zip(NAMES, TABLES)}


def snapshot(spark, d):
    """Where the same tables are written; once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        root = shared_dir(spark, "archive-index")
        write_snapshot(index_tables(spark, d), root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def stored(spark, d):
    """The written tables without a search index."""
    return read_archive(spark, snapshot(spark, d), list(NAMES))


def archive(spark, d):
    """The written tables with their index, as searches use it; indexed once per session."""
    root, tables = snapshot(spark, d), stored(spark, d)
    if root not in _INDEXED:
        write_index(tables, root)
        _INDEXED.add(root)
    return tables | read_index(spark, root)


def asked(spark, d):
    """Prepared queries."""
    return search.prepare(load(spark, d, "v_queries"))


LATEST = "SELECT * FROM v_extractions QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY extracted_at DESC, extraction_id DESC) = 1"

# Every evidence text against every needle, then plain aggregation.
EVIDENCE_CTES = f""", {CONCEPT_CTES},
usable AS (SELECT * FROM v_results WHERE is_current AND status IN ('complete', 'partial')),
targets AS (SELECT semantic_result_id, string_agg(target_ref, ' ' ORDER BY semantic_relation_id) AS t FROM v_semantic_relations GROUP BY 1),
newest AS ({LATEST}),
ends AS (SELECT DISTINCT relation_id, unnest([from_object_id, to_object_id]) AS object_id FROM v_edges),
raw AS (SELECT object_id, semantic_result_id AS evidence_id, 'semantic_result' AS evidence_kind, semantic_type, confidence, source_content_hash AS h,
    coalesce(result_text, '') || ' ' || coalesce(result_json, '') || ' ' || coalesce(t, '') AS body FROM usable LEFT JOIN targets USING (semantic_result_id)
  UNION ALL SELECT object_id, object_id, 'canonical_metadata', 'canonical_metadata', NULL, content_hash, metadata_json FROM v_objects
  UNION ALL SELECT n.object_id, extraction_id, 'derived_metadata', 'media_metadata', NULL, o.content_hash, n.metadata_json FROM newest n JOIN v_objects o ON o.object_id = n.object_id
  UNION ALL SELECT e.object_id, r.relation_id, 'object_relation', 'object_relation', r.confidence, o.content_hash, r.relation_type || ' ' || r.from_object_id || ' ' || r.to_object_id
    FROM ends e JOIN v_edges r ON r.relation_id = e.relation_id JOIN v_objects o ON o.object_id = e.object_id),
ev AS (SELECT *, {norm('body')} AS n FROM raw),
m AS (SELECT query_id, object_id, evidence_kind, evidence_id, semantic_type, confidence, h, body, list_sort(list(DISTINCT concept)) AS cs FROM ev JOIN q_terms ON {found_in('n', 'needle')} GROUP BY ALL),
places AS (SELECT query_id, unnest(list_distinct({toks('place')})) AS w FROM v_queries WHERE place IS NOT NULL),
place_ev AS (SELECT object_id, n FROM ev WHERE evidence_kind = 'derived_metadata' OR semantic_type = 'detected_places'),
place_n AS (SELECT query_id, count(*) AS need FROM places GROUP BY query_id),
place_hit AS (SELECT query_id, object_id, count(DISTINCT w) AS got FROM places JOIN place_ev ON {found_in('n', 'w')} GROUP BY ALL),
place_ok AS (SELECT query_id, object_id FROM place_hit JOIN place_n USING (query_id) WHERE got = need),
per AS (SELECT query_id, object_id, list_sort(list_distinct(flatten(list(cs)))) AS matched, count(*) AS n_evidence, coalesce(avg(confidence), 0.5) AS mean_confidence FROM m GROUP BY ALL),
requested AS (SELECT query_id, list(concept ORDER BY concept_rank) AS requested FROM q_concepts GROUP BY query_id),
scored AS (SELECT p.*, r.requested, o.object_type, o.occurred_at, o.captured_at, o.raw_uri, q.k, q.place, q.media_type, q.time_from,
    list_filter(r.requested, lambda c: NOT list_contains(p.matched, c)) AS missing,
    round(0.8 * (len(p.matched) / len(r.requested)) + 0.15 * mean_confidence + 0.05 * least(n_evidence, 3) / 3, 6) AS score
  FROM per p JOIN requested r USING (query_id) JOIN v_queries q USING (query_id) JOIN v_objects o ON o.object_id = p.object_id
  WHERE p.object_id IN (SELECT object_id FROM usable) AND (q.media_type IS NULL OR q.media_type = o.object_type)
    AND (q.time_from IS NULL OR CAST(coalesce(o.occurred_at, o.captured_at) AS TIMESTAMPTZ) >= CAST(q.time_from AS TIMESTAMPTZ))
    AND (q.time_to IS NULL OR CAST(coalesce(o.occurred_at, o.captured_at) AS TIMESTAMPTZ) <= CAST(q.time_to AS TIMESTAMPTZ))
    AND (q.place IS NULL OR EXISTS (SELECT 1 FROM place_ok k WHERE k.query_id = p.query_id AND k.object_id = p.object_id))),
hits AS (SELECT *, 'matched ' || len(matched) || '/' || len(requested) || ' concepts: ' || array_to_string(matched, ', ') || CASE WHEN len(missing) > 0 THEN '; missing derived evidence for: ' || array_to_string(missing, ', ') ELSE '' END AS reason,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS INT) AS rank FROM scored QUALIFY rank <= k)
"""


@query("query_concepts", f", {CONCEPT_CTES} SELECT query_id, concept_rank, concept, needle FROM q_terms", views=("v_queries",))
def query_concepts(spark, d):
    return search.query_concepts(asked(spark, d))


@query("query_rejects", """SELECT item_id AS query_id, CASE item_id % 8 WHEN 0 THEN 'query must not be empty' WHEN 1 THEN 'query is too long' WHEN 2 THEN 'limit must be between 1 and 100' WHEN 3 THEN 'query has no searchable terms'
 WHEN 4 THEN 'invalid time_from' WHEN 5 THEN 'invalid time_to' ELSE 'incompatible time filters' END AS error FROM benchmark WHERE item_id % 8 < 7""")
def query_rejects(spark, d):
    n = F.col("item_id") % 8
    none = F.lit(None).cast("string")
    queries = load(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(n == 0, " ").when(n == 1, F.repeat("text", 40)).when(n == 3, "the photo of").otherwise(F.col("text")).alias("query"),
        F.when(n == 2, 101).otherwise(100).alias("k"),
        F.when(n == 4, "last week").when(n == 6, "2024-01-01").otherwise(none).alias("time_from"),
        F.when(n == 5, "2024-02-30").when(n == 6, "2024-02-01T00:00:00Z").otherwise(none).alias("time_to"))
    return search.query_rejects(search.prepare(queries.withColumn("place", F.lit(None).cast("string"))))


HIT_SQL = "query_id, rank, object_id, object_type, score, reason, array_to_string(missing, ',') AS missing, n_evidence"


@query("search", EVIDENCE_CTES + f"SELECT {HIT_SQL} FROM hits", views=SEARCH_VIEWS)
def best_hits(spark, d):
    return search.search(archive(spark, d), load(spark, d, "v_queries")).hits.select(
        "query_id", "rank", "object_id", "object_type", "score", "reason", F.array_join("missing", ",").alias("missing"), "n_evidence")


@query("search_topk", EVIDENCE_CTES + "SELECT query_id, rank, object_id FROM hits", views=SEARCH_VIEWS)
def search_topk(spark, d):
    return search.search(archive(spark, d), load(spark, d, "v_queries")).hits.select("query_id", "rank", "object_id")


def all_hits(spark, d):
    tables, queries = archive(spark, d), asked(spark, d)
    return search.score_hits(search.query_matches(tables, queries), tables, queries)


@query("search_batch", EVIDENCE_CTES + "SELECT query_id, object_id, score, array_to_string(matched, ',') AS matched, n_evidence FROM scored", views=SEARCH_VIEWS)
def search_batch(spark, d):
    return all_hits(spark, d).select("query_id", "object_id", "score", F.array_join("matched", ",").alias("matched"), "n_evidence")


@query("search_filtered", EVIDENCE_CTES + "SELECT query_id, object_id, score FROM scored WHERE media_type IS NOT NULL OR time_from IS NOT NULL", views=SEARCH_VIEWS)
def search_filtered(spark, d):
    tables = archive(spark, d)
    queries = asked(spark, d).filter("media_type IS NOT NULL OR time_from IS NOT NULL")
    return search.score_hits(search.query_matches(tables, queries), tables, queries).select("query_id", "object_id", "score")


@query("search_place", EVIDENCE_CTES + "SELECT query_id, object_id, score FROM scored WHERE place IS NOT NULL", views=SEARCH_VIEWS)
def search_place(spark, d):
    tables, queries = archive(spark, d), asked(spark, d).filter("place IS NOT NULL")
    return search.score_hits(search.query_matches(tables, queries), tables, queries).select("query_id", "object_id", "score")


@query("search_summary", EVIDENCE_CTES + """, fnd AS (SELECT query_id, list_distinct(flatten(list(matched))) AS found, bool_or(len(missing) = 0) AS any_full FROM scored GROUP BY query_id),
s AS (SELECT query_id, requested, list_filter(requested, lambda c: NOT list_contains(coalesce(found, []), c)) AS unsupported, any_full FROM requested LEFT JOIN fnd USING (query_id))
SELECT query_id, array_to_string(requested, ',') AS requested, array_to_string(unsupported, ',') AS unsupported, len(unsupported) > 0 OR coalesce(NOT any_full, false) AS best_effort,
 CASE WHEN len(unsupported) > 0 THEN 'Current derived semantic evidence cannot verify: ' || array_to_string(unsupported, ', ') || '. Results are the closest candidates and must not be treated as canonical truth.' END AS explanation FROM s""", views=SEARCH_VIEWS)
def search_summary(spark, d):
    return search.search(archive(spark, d), load(spark, d, "v_queries")).summary.select(
        "query_id", F.array_join("requested", ",").alias("requested"), F.array_join("unsupported", ",").alias("unsupported"), "best_effort", "explanation")


SHOWN = f""", shown AS (SELECT m.*, CASE WHEN evidence_kind <> 'semantic_result' THEN substring(body, 1, 320) WHEN coalesce(r.result_text, '') <> '' THEN substring({collapse('r.result_text')}, 1, 320)
  WHEN m.semantic_type = 'detected_objects' THEN 'detected objects: ' || json_extract_string(r.result_json, '$.detections[0].label') || ', tree' ELSE 'place candidates: ' || CAST(json_extract(r.result_json, '$.candidates') AS VARCHAR) END AS snippet
  FROM m JOIN hits USING (query_id, object_id) LEFT JOIN v_results r ON r.semantic_result_id = m.evidence_id)
"""


@query("search_public", EVIDENCE_CTES + f""", src AS (SELECT query_id, object_id, array_to_string(list_sort(list(DISTINCT h)), ',') AS source_content_hashes, count(*) FILTER (evidence_kind = 'semantic_result') AS n_results, min(CASE WHEN evidence_kind = 'semantic_result' THEN evidence_id END) AS first_result_id FROM m GROUP BY ALL)
SELECT query_id, rank, object_id, score, occurred_at, reason, '{DEFAULT_IDS.ref_scheme}' || object_id AS safe_ref, CASE WHEN len(missing) > 0 THEN 'candidate' ELSE 'derived_evidence_match' END AS assessment,
 array_to_string(missing, ',') AS missing_evidence, false AS is_fact, source_content_hashes, n_results, first_result_id FROM hits JOIN src USING (query_id, object_id)""", views=SEARCH_VIEWS)
def search_public(spark, d):
    tables = archive(spark, d)
    answer = search.search(tables, load(spark, d, "v_queries"))
    shown = search.evidence_snippets(answer.evidence, tables)
    return compact.public_hits(answer.hits, shown).select(
        "query_id", "rank", "object_id", "score", "occurred_at", "reason", "safe_ref", "assessment",
        F.array_join("missing_evidence", ",").alias("missing_evidence"), "is_fact",
        F.array_join("source_content_hashes", ",").alias("source_content_hashes"), "n_results", "first_result_id")


@query("search_evidence", EVIDENCE_CTES + SHOWN + """SELECT query_id, s.object_id, evidence_kind, evidence_id, s.semantic_type, s.confidence, snippet,
 CASE WHEN evidence_kind = 'semantic_result' THEN r.extractor_name END AS extractor_name, CASE WHEN evidence_kind = 'semantic_result' THEN r.extractor_version END AS extractor_version,
 CASE WHEN evidence_kind = 'semantic_result' THEN r.created_at END AS created_at FROM shown s LEFT JOIN v_results r ON r.semantic_result_id = evidence_id""", views=SEARCH_VIEWS)
def search_evidence(spark, d):
    tables = archive(spark, d)
    answer = search.search(tables, load(spark, d, "v_queries"))
    return search.evidence_snippets(answer.evidence, tables).select(
        "query_id", "object_id", "evidence_kind", "evidence_id", "semantic_type", "confidence", "snippet", "extractor_name", "extractor_version", "created_at")


@query("evidence_compact", EVIDENCE_CTES + SHOWN + r""", known AS (SELECT query_id, object_id, CASE semantic_type WHEN 'image_caption' THEN 'caption' WHEN 'detected_objects' THEN 'object' WHEN 'detected_places' THEN 'place' ELSE 'metadata' END AS type,
  CASE WHEN semantic_type = 'canonical_metadata' THEN 'canonical metadata matched (private details redacted)' WHEN semantic_type = 'media_metadata' THEN snippet
    ELSE regexp_replace(snippet, '(?i)[^\s"'']+[\\/][^\s"'']+\.(?:jpe?g|png|webp|heic|mp4|mov|m4a|mp3|wav)', '[private-reference-redacted]', 'g') END AS value,
  round(coalesce(confidence, 0.0::DOUBLE), 6) AS confidence, false AS is_fact, 'candidate' AS assessment FROM shown)
SELECT * FROM known UNION ALL SELECT query_id, object_id, CASE WHEN c = 'swimwear' THEN 'object' ELSE 'metadata' END, 'unconfirmed: ' || c, 0.0::DOUBLE, false, 'inference' FROM (SELECT query_id, object_id, unnest(missing) AS c FROM hits) u""", views=SEARCH_VIEWS)
def evidence_compact(spark, d):
    tables = archive(spark, d)
    answer = search.search(tables, load(spark, d, "v_queries"))
    return compact.compact_hits(answer.hits, search.evidence_snippets(answer.evidence, tables))


DETAILS = """, nw AS (SELECT * FROM v_extractions QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY extracted_at DESC, extraction_id DESC) = 1),
us AS (SELECT * FROM v_results WHERE is_current AND status IN ('complete', 'partial')),
det AS (SELECT o.object_id, coalesce(o.occurred_at, o.captured_at) AS occurred_at, CAST(json_extract_string(nw.metadata_json, '$.gps.latitude') AS DOUBLE) AS latitude, CAST(json_extract_string(nw.metadata_json, '$.gps.longitude') AS DOUBLE) AS longitude,
  substring(c.result_text, 1, 1000) AS caption, coalesce(json_extract_string(b.result_json, '$.detections[0].label') || ',tree', '') AS concepts, CAST(json_extract_string(p.result_json, '$.candidates[0].latitude') AS DOUBLE) AS place_latitude
FROM v_objects o LEFT JOIN nw ON nw.object_id = o.object_id LEFT JOIN us c ON c.object_id = o.object_id AND c.semantic_type = 'image_caption' LEFT JOIN us b ON b.object_id = o.object_id AND b.semantic_type = 'detected_objects'
LEFT JOIN us p ON p.object_id = o.object_id AND p.semantic_type = 'detected_places' WHERE o.object_type = 'photo')
"""


def details(spark, d):
    return compact.media_details(stored(spark, d)).withColumn("concepts", F.array_join("concepts", ",")).withColumn(
        "place_latitude", F.get("place_candidates", 0)["latitude"]).drop("place_candidates")


@query("media_details", DETAILS + "SELECT * FROM det", views=TABLES)
def media_details(spark, d):
    return details(spark, d)


@query("search_enriched", EVIDENCE_CTES + DETAILS + "SELECT query_id, rank, h.object_id, h.score, det.caption, det.concepts, det.latitude, det.occurred_at AS shown_at FROM hits h LEFT JOIN det ON det.object_id = h.object_id", views=SEARCH_VIEWS)
def search_enriched(spark, d):
    hits = search.search(archive(spark, d), load(spark, d, "v_queries")).hits.select("query_id", "rank", "object_id", "score")
    return compact.enrich(hits, details(spark, d)).select("query_id", "rank", "object_id", "score", "caption", "concepts", "latitude", "shown_at")


@query("object_record", f"""SELECT o.object_id, o.object_type, '{DEFAULT_IDS.ref_scheme}' || o.object_id AS safe_ref, a.blob_id, o.content_hash, r.semantic_result_id, r.semantic_type, r.status, r.confidence, r.source_blob_id
FROM v_objects o LEFT JOIN v_attachments a ON a.object_id = o.object_id LEFT JOIN (SELECT * FROM v_results WHERE is_current) r ON r.object_id = o.object_id""", views=TABLES)
def object_record(spark, d):
    views, current = search.object_records(stored(spark, d))
    rows = views.join(current.select("object_id", "semantic_result_id", "semantic_type", "status", "confidence", "source_blob_id"), "object_id", "left")
    return rows.select("object_id", "object_type", "safe_ref", "blob_id", "content_hash", "semantic_result_id", "semantic_type", "status", "confidence", "source_blob_id")


@query("object_edges", """SELECT e.object_id, e.relation_id, r.relation_type, r.confidence FROM (SELECT DISTINCT relation_id, unnest([from_object_id, to_object_id]) AS object_id FROM v_edges) e
JOIN v_edges r USING (relation_id) WHERE e.object_id IN (SELECT object_id FROM v_results WHERE is_current AND status IN ('complete', 'partial'))""", views=TABLES)
def object_edges(spark, d):
    tables = stored(spark, d)
    edges = search.evidence(tables)["object_relation"].join(search.candidates(tables).select("object_id"), "object_id", "left_semi")
    kinds = tables["relations"].select(F.col("relation_id").alias("evidence_id"), "relation_type")
    return edges.join(kinds, "evidence_id").select("object_id", F.col("evidence_id").alias("relation_id"), "relation_type", "confidence")
