"""Conversation exports: scan, nodes, parents, import outcomes, relations, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake import shared_dir
from keepsake.functions.ids import DEFAULT_IDS
from keepsake.operators.upsert import merge_parent_edges, mirror_parents
from keepsake.plans import conversations as plan
from keepsake.sources.conversations import conversation_nodes, scan_conversations
from keepsake.sources.snapshots import SnapshotLog

from .dialects import object_id
from .fragments import DUCK
from .registry import query
from .views import load

EXPORT_VIEWS = ("v_exports", "v_conv_stored", "v_conv_relations")
CONV, NODE, MSG = "'chatgpt.conversation'", "'chatgpt.node'", "'chatgpt.message'"


def documents(spark, d):
    return load(spark, d, "v_exports").select(
        "doc_id", F.concat(F.lit("file:///exports/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("raw_uri"), "body")


def imported(spark, d):
    return plan.read_import(documents(spark, d))


def stored_objects(spark, d):
    return load(spark, d, "v_conv_stored")


# Objects, edges and outcomes by the rule the documents were made with.
EXPECTED = f""", ok AS (SELECT * FROM v_exports WHERE v <> 2), mapped AS (SELECT * FROM ok WHERE v NOT IN (3, 9)),
nodes AS (SELECT *, 'm' AS key, CASE v WHEN 4 THEN 1 ELSE 0 END AS pos, sha256(node_json) AS h FROM mapped
  UNION ALL SELECT *, 'root', CASE v WHEN 4 THEN 2 ELSE 1 END, sha256(root_json) FROM mapped
  UNION ALL SELECT *, 'bad', 0, sha256('{{}}') FROM mapped WHERE v = 4),
objs AS (SELECT 'chatgpt_conversation' AS object_type, {CONV} AS source, cid AS source_id, sha256(conv_json) AS content_hash, '2023-11-14T22:13:20.500000+00:00' AS occurred_at, NULL AS topic, doc_id, v, 0 AS pos, 0 AS kind FROM ok
  UNION ALL SELECT 'chatgpt_node', {NODE}, cid || '/' || key, h, CASE WHEN key = 'm' THEN strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END, NULL, doc_id, v, pos, 1 FROM nodes
  UNION ALL SELECT 'chatgpt_message_' || role, {MSG}, mid, sha256(message_json), strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00', CASE v WHEN 6 THEN 'thoughts' ELSE 'text' END, doc_id, v, pos, 2 FROM nodes WHERE key = 'm' AND v <> 5),
keyed AS (SELECT *, {object_id(DUCK, 'source', 'source_id')} AS object_id, CASE v WHEN 1 THEN 1 ELSE 0 END::BIGINT AS conv_pos, pos::BIGINT AS node_pos FROM objs),
judged AS (SELECT k.*, coalesce(lag(k.content_hash) OVER (PARTITION BY k.source, k.source_id ORDER BY doc_id, conv_pos, node_pos, kind), s.content_hash) AS before FROM keyed k LEFT JOIN v_conv_stored s USING (source, source_id)),
outcomes AS (SELECT *, CASE WHEN before IS NULL THEN 'inserted' WHEN before = content_hash THEN 'unchanged' ELSE 'changed' END AS outcome FROM judged),
edges AS (SELECT 'conversation_contains_node' AS relation_type, {object_id(DUCK, CONV, 'cid')} AS from_object_id, {object_id(DUCK, NODE, "(cid || '/' || key)")} AS to_object_id, 'inserted' AS outcome FROM nodes
  UNION ALL SELECT DISTINCT 'node_contains_message', {object_id(DUCK, NODE, "(cid || '/m')")}, {object_id(DUCK, MSG, 'mid')}, 'inserted' FROM nodes WHERE key = 'm' AND v <> 5
  UNION ALL SELECT 'node_parent', {object_id(DUCK, NODE, "(cid || '/root')")}, {object_id(DUCK, NODE, "(cid || '/m')")}, CASE WHEN v = 8 THEN 'removed' WHEN conv_id % 2 = 0 THEN 'unchanged' ELSE 'inserted' END FROM mapped WHERE v <> 8 OR conv_id % 2 = 0
  UNION ALL SELECT 'node_parent', {object_id(DUCK, NODE, "(cid || '/old')")}, {object_id(DUCK, NODE, "(cid || '/m')")}, 'removed' FROM mapped WHERE conv_id % 7 = 0),
warns AS (SELECT 'conversation_missing_id' AS code, NULL AS source_id FROM v_exports WHERE v = 2 UNION ALL SELECT 'invalid_mapping', cid FROM ok WHERE v = 3
  UNION ALL SELECT 'invalid_node', 'bad' FROM ok WHERE v = 4 UNION ALL SELECT 'message_missing_id', 'm' FROM ok WHERE v = 5
  UNION ALL SELECT 'content_not_normalized', mid FROM ok WHERE v = 6 UNION ALL SELECT 'attachments_not_indexed', mid FROM ok WHERE v = 7 UNION ALL SELECT 'missing_parent', 'm' FROM ok WHERE v = 8)
"""


@query("scan_conversations", """SELECT doc_id, CAST(CASE v WHEN 1 THEN 1 ELSE 0 END AS INT) AS conv_pos, CASE v WHEN 2 THEN NULL ELSE cid END AS conv_id,
 CASE v WHEN 3 THEN 'invalid' WHEN 9 THEN 'empty' ELSE 'object' END AS mapping_state, sha256(conv_json) AS content_hash FROM v_exports""", views=("v_exports",))
def scan(spark, d):
    return scan_conversations(documents(spark, d)).select("doc_id", "conv_pos", "conv_id", "mapping_state", "content_hash")


@query("conv_nodes", EXPECTED + """SELECT cid AS conv_id, key AS node_id, CASE WHEN key = 'm' THEN CASE v WHEN 8 THEN 'gone' ELSE 'root' END END AS parent_key, key <> 'bad' AS is_object, h AS node_hash,
 key = 'm' AS has_message, CASE WHEN key = 'm' AND v <> 5 THEN mid END AS message_id FROM nodes
UNION ALL SELECT cid, NULL, NULL, false, NULL, false, NULL FROM ok WHERE v IN (3, 9)""", views=EXPORT_VIEWS)
def nodes(spark, d):
    known = scan_conversations(documents(spark, d)).filter("conv_id IS NOT NULL")
    return conversation_nodes(known).select("conv_id", "node_id", "parent_key", "is_object", "node_hash", "has_message", "message_id")


@query("conv_parents", """SELECT n.node_id, p.node_id AS parent_id, n.parent_key IS NOT NULL AND p.node_id IS NULL AS parent_missing
FROM v_conv_nodes n LEFT JOIN v_conv_nodes p ON p.conv_id = n.conv_id AND p.node_id = n.parent_key""", views=("v_conv_nodes",))
def parents(spark, d):
    nodes = load(spark, d, "v_conv_nodes").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("conv_pos"), F.col("turn").alias("node_pos"), F.col("conv_id").cast("string").alias("conv_id"),
        "node_id", "parent_key", F.col("node_id").alias("node_oid"))
    return plan.resolve_parents(nodes).select("node_id", "parent_id", "parent_missing")


@query("conv_objects", EXPECTED + "SELECT object_id, object_type, source, source_id, content_hash, occurred_at, topic, outcome, doc_id, conv_pos, node_pos, kind FROM outcomes", views=EXPORT_VIEWS)
def objects(spark, d):
    return plan.import_outcomes(imported(spark, d), stored_objects(spark, d)).select(
        "object_id", "object_type", "source", "source_id", "content_hash", "occurred_at", "topic", "outcome", "ordinal.*")


@query("conv_relations", EXPECTED + f"SELECT relation_type, from_object_id, to_object_id, outcome, '{DEFAULT_IDS.prefix}_rel_' || {DUCK.uuid('''('relation:' || relation_type || ':' || from_object_id || ':' || to_object_id)''')} AS relation_id FROM edges", views=EXPORT_VIEWS)
def relations(spark, d):
    return plan.edge_outcomes(imported(spark, d), load(spark, d, "v_conv_relations")).select(
        "relation_type", "from_object_id", "to_object_id", "outcome", "relation_id")


@query("parent_edges", EXPECTED + "SELECT from_object_id AS parent_id, to_object_id AS child_id, outcome FROM edges WHERE relation_type = 'node_parent'", views=EXPORT_VIEWS)
def parent_edges(spark, d):
    stored = load(spark, d, "v_conv_relations").select(F.col("to_object_id").alias("child_id"), F.col("from_object_id").alias("parent_id"))
    return merge_parent_edges(stored, imported(spark, d).parents.select("child_id", "parent_id", "ordinal"))


@query("conv_diagnostics", EXPECTED + "SELECT 'warning' AS severity, code, source_id FROM warns", views=EXPORT_VIEWS)
def diagnostics(spark, d):
    return imported(spark, d).diagnostics.select("severity", "code", "source_id")


@query("import_stats", EXPECTED + """SELECT kind, outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source AS kind, outcome, 1 AS n FROM outcomes UNION ALL SELECT relation_type, outcome, 1 FROM edges UNION ALL SELECT 'warning', code, 1 FROM warns) x GROUP BY ALL""", views=EXPORT_VIEWS)
def stats(spark, d):
    batch = imported(spark, d)
    outcomes = plan.import_outcomes(batch, stored_objects(spark, d))
    edges = plan.edge_outcomes(batch, load(spark, d, "v_conv_relations"))
    return plan.import_stats(outcomes, edges, batch.diagnostics)


@query("version_parent", """, v AS (SELECT conv_id, turn, node_id, parent_key, n, sha256(text || n) AS content_hash FROM v_conv_nodes CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) g)
SELECT node_id, CAST(n AS BIGINT) AS version, CASE WHEN n = 1 + turn % 2 THEN parent_key ELSE 'stale' END AS parent_id FROM v""", views=("v_conv_nodes",))
def version_parent(spark, d):
    base = load(spark, d, "v_conv_nodes")
    hash_of = lambda n: F.sha2(F.concat("text", n.cast("string")), 256)
    versions = base.select(F.col("node_id").alias("object_id"), "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select(
        "object_id", F.col("n").cast("bigint").alias("version"), hash_of(F.col("n")).alias("content_hash"), F.lit("stale").alias("parent_id"))
    live = base.select(F.col("node_id").alias("object_id"), hash_of((F.col("turn") % 2 + 1).cast("int")).alias("content_hash"), F.col("parent_key").alias("parent_id"))
    return mirror_parents(versions, live).select(F.col("object_id").alias("node_id"), "version", "parent_id")


_ARCHIVES: dict[tuple[str, str], SnapshotLog] = {}
FIRST, SECOND = "2025-01-01T00:00:00+00:00", "2025-02-01T00:00:00+00:00"


def archive(spark, d):
    """An archive after two imports: half of the documents, then all of them; written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ARCHIVES:
        log = SnapshotLog(spark, shared_dir(spark, "conversation-archive"), buckets=8)
        given = documents(spark, d)
        for number, (at, part) in enumerate(((FIRST, given.filter("doc_id % 2 = 0")), (SECOND, given)), 1):
            plan.import_conversations(part, log, "file:///exports", at, f"run-{number}")
        _ARCHIVES[key] = log
    return _ARCHIVES[key]


# Deliveries of both imports in order; the state after them, and the versions they brought.
ARCHIVED = EXPECTED + f""", delivered AS (SELECT k.*, r.run, row_number() OVER (ORDER BY r.run, doc_id, conv_pos, node_pos, kind) AS o
  FROM keyed k JOIN (SELECT 1 AS run UNION ALL SELECT 2) r ON r.run = 2 OR doc_id % 2 = 0),
node_ids AS (SELECT doc_id, key, {object_id(DUCK, NODE, "(cid || '/' || key)")} AS oid FROM nodes),
state AS (SELECT object_id, arg_max(object_type, o) AS object_type, arg_max(source, o) AS source, arg_max(source_id, o) AS source_id, arg_max(content_hash, o) AS content_hash,
  arg_max(occurred_at, o) AS occurred_at, arg_min(doc_id, o) AS first_doc, arg_max(v, o) AS v, CAST(count(DISTINCT content_hash) AS BIGINT) AS n_versions FROM delivered GROUP BY 1)
"""


@query("archive_objects", ARCHIVED + f"""SELECT s.object_id, object_type, source, source_id, content_hash, occurred_at, n_versions,
  CASE WHEN source = {MSG} THEN m.oid WHEN source = {NODE} AND source_id LIKE '%/m' AND v <> 8 THEN r.oid END AS parent_id
FROM state s LEFT JOIN node_ids m ON m.doc_id = s.first_doc AND m.key = 'm' LEFT JOIN node_ids r ON r.doc_id = s.first_doc AND r.key = 'root'""", views=EXPORT_VIEWS)
def archive_objects(spark, d):
    log = archive(spark, d)
    counts = log.read("object_versions").groupBy("object_id").agg(F.count("*").alias("n_versions"))
    return log.read("objects").join(counts, "object_id").select(
        "object_id", "object_type", "source", "source_id", "content_hash", "occurred_at", "n_versions", "parent_id")


@query("archive_relations", EXPECTED + f"""SELECT '{DEFAULT_IDS.prefix}_rel_' || {DUCK.uuid('''('relation:' || relation_type || ':' || from_object_id || ':' || to_object_id)''')} AS relation_id, relation_type, from_object_id, to_object_id,
  CASE WHEN min(odd) = 0 THEN '{FIRST}' ELSE '{SECOND}' END AS created_at
FROM (SELECT 'conversation_contains_node' AS relation_type, {object_id(DUCK, CONV, 'cid')} AS from_object_id, {object_id(DUCK, NODE, "(cid || '/' || key)")} AS to_object_id, doc_id % 2 AS odd FROM nodes
  UNION ALL SELECT 'node_contains_message', {object_id(DUCK, NODE, "(cid || '/m')")}, {object_id(DUCK, MSG, 'mid')}, doc_id % 2 FROM nodes WHERE key = 'm' AND v <> 5
  UNION ALL SELECT 'node_parent', {object_id(DUCK, NODE, "(cid || '/root')")}, {object_id(DUCK, NODE, "(cid || '/m')")}, doc_id % 2 FROM mapped WHERE v <> 8) e
GROUP BY relation_type, from_object_id, to_object_id""", views=EXPORT_VIEWS)
def archive_relations(spark, d):
    return archive(spark, d).read("relations").select("relation_id", "relation_type", "from_object_id", "to_object_id", "created_at")


@query("archive_runs", ARCHIVED + f"""SELECT 'run-' || r.run AS import_id, 'complete' AS status, CASE r.run WHEN 1 THEN '{FIRST}' ELSE '{SECOND}' END AS started_at,
  (SELECT count(*) FROM delivered x WHERE x.run = r.run AND kind = 0) AS conversations,
  (SELECT count(*) FROM v_exports WHERE v IN (2, 3, 4, 5, 6, 7, 8) AND (r.run = 2 OR doc_id % 2 = 0)) AS warnings
FROM (SELECT 1 AS run UNION ALL SELECT 2) r""", views=EXPORT_VIEWS)
def archive_runs(spark, d):
    log = archive(spark, d)
    kinds = [f"{plan.CONVERSATION}.{outcome}" for outcome in ("inserted", "changed", "unchanged", "conflict")]
    counted = lambda name: F.coalesce(F.get_json_object("stats_json", f"$['{name}']").cast("long"), F.lit(0))
    notes = log.read("import_diagnostics").groupBy("import_id").agg(F.count("*").alias("warnings"))
    return log.runs().join(notes, "import_id").select(
        "import_id", "status", "started_at", sum((counted(k) for k in kinds), F.lit(0).cast("long")).alias("conversations"), "warnings")
