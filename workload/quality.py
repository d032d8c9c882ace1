"""Constraint checks, audits, parity and health over the archive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.contracts import SCHEMA_VERSION, TABLES as CONTRACTS
from keepsake.functions import redact
from keepsake.operators import quality, search
from keepsake.plans.reports import idempotence_report, ingest_twice, provider_roundtrip
from keepsake.sources import manifest

from .deliveries import MANIFEST_CTE, listing_pages
from .registry import query
from .scalars import SEEDED, seeded
from .searching import EVIDENCE_CTES, SEARCH_VIEWS, TABLES, archive, asked, index_tables, stored
from .views import load

# The archive with faults: doubled objects, doubled and overconfident results, lost blobs.
DIRTY_VIEWS = (*TABLES, "v_blobs", "v_metadata_diagnostics")
DIRTY_CTES = """, objects AS (SELECT * FROM v_objects UNION ALL SELECT * FROM v_objects WHERE source_id LIKE '%00'),
semantic_results AS (SELECT * REPLACE (CASE WHEN status = 'partial' THEN confidence + 0.75 ELSE confidence END AS confidence, CASE WHEN semantic_type = 'detected_places' THEN 'odd' ELSE status END AS status) FROM v_results
  UNION ALL SELECT * REPLACE ('again-' || semantic_result_id AS semantic_result_id) FROM v_results WHERE semantic_type = 'detected_objects'),
attachments AS (SELECT * FROM v_attachments), relations AS (SELECT * REPLACE (CASE WHEN relation_type = 'follows' THEN 'lost' ELSE to_object_id END AS to_object_id) FROM v_edges),
blobs AS (SELECT * REPLACE (CASE WHEN sha256 LIKE '1%' THEN -1 ELSE byte_size END AS byte_size) FROM v_blobs WHERE sha256 NOT LIKE '0%'), semantic_relations AS (SELECT * FROM v_semantic_relations),
metadata_extractions AS (SELECT * FROM v_extractions), metadata_diagnostics AS (SELECT * FROM v_metadata_diagnostics UNION ALL SELECT * FROM v_metadata_diagnostics WHERE severity = 'error')
"""
DIRTY = ("objects", "semantic_results", "attachments", "relations", "blobs", "semantic_relations", "metadata_extractions", "metadata_diagnostics")


def dirty(spark, d):
    tables = index_tables(spark, d)
    tables["blobs"], tables["metadata_diagnostics"] = load(spark, d, "v_blobs"), load(spark, d, "v_metadata_diagnostics")
    objects, results = tables["objects"], tables["semantic_results"]
    again = results.filter("semantic_type = 'detected_objects'").withColumn("semantic_result_id", F.concat(F.lit("again-"), "semantic_result_id"))
    spoiled = results.withColumn("confidence", F.when(F.col("status") == "partial", F.col("confidence") + 0.75).otherwise(F.col("confidence")))
    spoiled = spoiled.withColumn("status", F.when(F.col("semantic_type") == "detected_places", "odd").otherwise(F.col("status")))
    diagnostics = tables["metadata_diagnostics"]
    return tables | {
        "objects": objects.unionByName(objects.filter("source_id LIKE '%00'")),
        "semantic_results": spoiled.unionByName(again),
        "relations": tables["relations"].withColumn("to_object_id", F.when(F.col("relation_type") == "follows", "lost").otherwise(F.col("to_object_id"))),
        "blobs": tables["blobs"].filter("sha256 NOT LIKE '0%'").withColumn("byte_size", F.when(F.col("sha256").startswith("1"), -1).otherwise(F.col("byte_size"))),
        "metadata_diagnostics": diagnostics.unionByName(diagnostics.filter("severity = 'error'")),
    }


def unique_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{','.join(keys)}' AS key_columns, count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM "
        f"(SELECT count(*) AS n FROM {name} WHERE {' AND '.join(f'{key} IS NOT NULL' for key in keys)} GROUP BY {', '.join(keys)} HAVING count(*) > 1) t"
        for name in DIRTY for keys in CONTRACTS[name].unique
    )


def foreign_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table, count(DISTINCT {column}) AS missing_keys, count(*) AS orphan_rows FROM {name} c "
        f"WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"
        for name in DIRTY for column, (parent, key) in CONTRACTS[name].references.items() if parent in DIRTY
    )


def check_sql() -> str:
    rows = []
    for name in DIRTY:
        rows += [f"SELECT '{name}' AS table_name, 'check:{rule}' AS rule, count(*) FILTER (NOT coalesce({text}, true)) AS violations FROM {name}" for rule, text in CONTRACTS[name].checks.items()]
        rows += [f"SELECT '{name}' AS table_name, 'required:{column}' AS rule, count(*) FILTER ({column} IS NULL) AS violations FROM {name}" for column in CONTRACTS[name].required]
    return "\nUNION ALL ".join(rows)


@query("dq_unique", DIRTY_CTES + unique_sql(), views=DIRTY_VIEWS)
def dq_unique(spark, d):
    return quality.all_unique(dirty(spark, d))


@query("dq_foreign_keys", DIRTY_CTES + foreign_sql(), views=DIRTY_VIEWS)
def dq_foreign_keys(spark, d):
    return quality.all_foreign_keys(dirty(spark, d))


@query("dq_checks", DIRTY_CTES + check_sql(), views=DIRTY_VIEWS)
def dq_checks(spark, d):
    return quality.all_checks(dirty(spark, d))


@query("dq_one_current", DIRTY_CTES + "SELECT object_id, extractor_name, semantic_type, count(*) FILTER (is_current) AS n_current FROM semantic_results GROUP BY ALL HAVING count(*) FILTER (is_current) > 1", views=DIRTY_VIEWS)
def dq_one_current(spark, d):
    return quality.more_than_one_current(dirty(spark, d)["semantic_results"])


@query("table_counts", DIRTY_CTES + "\nUNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in DIRTY), views=DIRTY_VIEWS)
def table_counts(spark, d):
    return quality.table_counts(dirty(spark, d))


@query("hash_audit", "SELECT object_id, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM v_objects", views=("v_objects",))
def hash_audit(spark, d):
    found = load(spark, d, "documents").filter("doc_id % 10 <> 1").select(
        F.concat(F.lit("file:///archive/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("raw_uri"),
        F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return quality.hash_audit(load(spark, d, "v_objects"), found)


@query("rank_parity", EVIDENCE_CTES + "SELECT query_id, count(*) AS n_ranks, true AS rank_matches FROM hits GROUP BY query_id", views=SEARCH_VIEWS)
def rank_parity(spark, d):
    tables, queries = archive(spark, d), asked(spark, d)
    plain = search.top_hits(search.score_hits(search.scan_matches(tables, queries), tables, queries))
    sets = search.written_sets(tables, search.evidence_matches(tables, queries))
    return quality.rank_parity(search.best_of(sets, tables, queries), plain)


@query("rank_differs", EVIDENCE_CTES + "SELECT query_id, count(*) AS n_ranks, query_id % 3 <> 0 AS rank_matches FROM hits GROUP BY query_id", views=SEARCH_VIEWS)
def rank_differs(spark, d):
    """Rankings of which every third query has another object in the first place."""
    ranked = search.search(archive(spark, d), load(spark, d, "v_queries")).hits.select("query_id", "rank", "object_id")
    wrong = (F.col("query_id") % 3 == 0) & (F.col("rank") == 1)
    return quality.rank_parity(ranked, ranked.withColumn("object_id", F.when(wrong, F.lit("another")).otherwise(F.col("object_id"))))


@query("leak_report", rf"""SELECT 'raw' AS column_name, count(*) FILTER (contains(lower(t), 'file:///') OR regexp_matches(t, '(?i)\b[a-z]:[\\/]')) AS leaking_rows FROM (SELECT {SEEDED} AS t FROM documents) x UNION ALL SELECT 'safe', 0""")
def leak_report(spark, d):
    public = load(spark, d, "documents").select(
        F.to_json(F.struct(seeded().alias("text"))).alias("raw"),
        F.to_json(F.struct(redact.redact_paths(seeded()).alias("text"))).alias("safe"))
    return quality.leak_report(public, ["raw", "safe"])


@query("schema_align", "SELECT object_id, '{}' AS metadata_json, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS DOUBLE) AS confidence, source_id FROM v_objects", views=("v_objects",))
def schema_align(spark, d):
    older = load(spark, d, "v_objects").drop("metadata_json", "event_id", "confidence", "doc_id")
    now = quality.align(older, CONTRACTS["objects"])
    if quality.schema_issues(now, CONTRACTS["objects"]):
        raise ValueError("alignment left differences")
    return now.select("object_id", "metadata_json", "event_id", "confidence", "source_id")


@query("health_report", """SELECT true AS database_available, 5 AS schema_version, true AS schema_up_to_date, true AS search_available, '' AS issues, 'OK' AS status, (SELECT count(*) FROM v_objects) AS n_objects, (SELECT count(*) FROM v_blobs) AS n_blobs,
 (SELECT count(*) FROM v_attachments) AS n_attachments, (SELECT count(*) FROM v_results) AS n_semantic_results, (SELECT count(*) FROM v_extractions) AS n_metadata_extractions, CAST(1 AS BIGINT) AS probe_hits""", views=(*TABLES, "v_blobs"))
def health_report(spark, d):
    tables = archive(spark, d)
    tables["blobs"] = load(spark, d, "v_blobs")
    none = F.lit(None).cast("string")
    probe = spark.range(1).select(F.col("id").alias("query_id"), F.lit("person").alias("query"), F.lit("photo").alias("media_type"),
                                  none.alias("time_from"), none.alias("time_to"), none.alias("place"), F.lit(1).alias("k"))
    return quality.health_report(spark, tables, search.search(tables, probe).hits, SCHEMA_VERSION, SCHEMA_VERSION)


@query("health_issues", f"""SELECT 'older' AS archive, {SCHEMA_VERSION - 1} AS schema_version, 'schema_version {SCHEMA_VERSION - 1} does not match expected {SCHEMA_VERSION}' AS issues, 'WARNING' AS status, (SELECT count(*) FROM v_objects) AS n_objects
UNION ALL SELECT 'no blobs', {SCHEMA_VERSION}, 'table is missing: blobs; read-only search is unavailable', 'WARNING', (SELECT count(*) FROM v_objects)
UNION ALL SELECT 'no objects', 0, 'schema_version 0 does not match expected {SCHEMA_VERSION}; table is missing: objects; read-only search is unavailable', 'ERROR', NULL""", views=(*TABLES, "v_blobs"))
def health_issues(spark, d):
    """Archives with faults: an older layout, one table that is not there, nothing to index."""
    tables = {**stored(spark, d), "blobs": load(spark, d, "v_blobs")}
    without = lambda name: {key: df for key, df in tables.items() if key != name}
    version = lambda n: spark.createDataFrame([(k, "2024-01-01") for k in range(1, n + 1)], "version int, applied_at string")
    probe = load(spark, d, "v_objects").limit(1)
    cases = {"older": ({**tables, "schema_migrations": version(SCHEMA_VERSION - 1)}, probe),
             "no blobs": ({**without("blobs"), "schema_migrations": version(SCHEMA_VERSION)}, None), "no objects": (without("objects"), None)}
    rows = None
    for name, (held, hits) in cases.items():
        row = quality.health_report(spark, held, hits, quality.stored_version(held), SCHEMA_VERSION)
        count = F.col("n_objects") if "n_objects" in row.columns else F.lit(None).cast("bigint").alias("n_objects")
        row = row.select(F.lit(name).alias("archive"), "schema_version", "issues", "status", count)
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("idempotence_report", "SELECT (SELECT count(*) FROM documents) AS n_first, true AS ids_stable, true AS all_unchanged_on_repeat, true AS counts_stable_on_repeat")
def idempotence(spark, d):
    # Objects stored under another id are conflicts in every run; give them their own ids.
    # The other id is a mark before the whole own id, which may begin with the same characters.
    own_id = F.regexp_replace("object_id", "^kps_obj_0000(?=kps_obj_)", "")
    items = load(spark, d, "v_items1")
    stored = load(spark, d, "v_stored").withColumn("object_id", own_id)
    versions = load(spark, d, "v_stored_versions").withColumn("object_id", own_id)
    first, state, grown, second = ingest_twice(items, stored, versions)
    later = grown.unionByName(second.new_versions.select(*grown.columns))
    counts = [quality.table_counts({"objects": o, "versions": v}) for o, v in ((state, grown), (second.objects, later))]
    return idempotence_report(first.outcomes, second.outcomes, *counts, "object_id")


@query("provider_roundtrip", MANIFEST_CTE + "SELECT 'drive:' || id AS source_id, 'inserted' AS first_outcome, 'unchanged' AS repeat_outcome, true AS stable_object_id, true AS raw_uri_matches, 'gdrive' AS raw_uri_scheme, true AS provider_metadata_preserved FROM m WHERE error IS NULL", views=("v_manifest",))
def roundtrip(spark, d):
    photos = manifest.manifest_photos(listing_pages(spark, d), "drive").filter("error IS NULL")
    items = photos.select(
        F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("ordinal"), F.lit("photo").alias("object_type"), F.col("source_kind").alias("source"),
        "source_id", "raw_uri", F.encode("name", "UTF-8").alias("content"), F.lit(None).cast("string").alias("occurred_at"),
        F.lit("2024-06-01T00:00:00+00:00").alias("captured_at"), "mime_type", "metadata_json")
    first, state, _, second = ingest_twice(items, load(spark, d, "v_stored"), load(spark, d, "v_stored_versions"))
    return provider_roundtrip(photos, first.outcomes, second.outcomes, state)
