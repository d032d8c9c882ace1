"""Import of conversation exports: objects, relations, diagnostics and counters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import DEFAULT_IDS, IdSpace
from ..functions.timegeo import unix_to_iso
from ..operators.hotkeys import latest
from ..operators.upsert import append_versions, apply_outcomes, classify, insert_absent, merge_parent_edges, mirror_parents
from ..session import materialise
from ..sources.conversations import DOCS_PER_CHUNK, conversation_nodes, ordinal, scan_conversations, scan_lines
from ..sources.snapshots import Snapshot, SnapshotLog

# Sources and types of imported objects.
CONVERSATION, NODE, MESSAGE = "chatgpt.conversation", "chatgpt.node", "chatgpt.message"
UNNORMALISED = ("reasoning_recap", "thoughts")


@dataclass(frozen=True)
class ConversationImport:
    """``objects`` in delivery order, ``edges`` by containment, ``parents`` per node."""

    objects: DataFrame
    edges: DataFrame
    parents: DataFrame
    diagnostics: DataFrame


def read_import(documents: DataFrame, ids: IdSpace = DEFAULT_IDS, scoped_nodes: bool = True, strict: bool = True,
                lines: bool = False) -> ConversationImport:
    """What an export says, as object, edge and diagnostic rows.

    With ``lines`` every document is one conversation, as ``read_exports(..., lines=True)``
    gives them. What cannot be read is named in the diagnostics.

    The JSON is parsed once into a written table of nodes; everything else reads that.
    Node keys are unique within their conversation only, so by default the conversation
    is part of a node's identity; ``scoped_nodes=False`` takes keys as global.
    """
    scanned = scan_lines(documents) if lines else scan_conversations(documents, strict)
    # Without an id a conversation is skipped, its nodes with it.
    skipped = F.when(F.col("conv_id").isNotNull(), F.col("mapping"))
    rows = materialise(conversation_nodes(scanned.withColumn("mapping", skipped)), "conversation-nodes")
    conversations = rows.filter(F.coalesce("node_pos", F.lit(0)) == 0)
    known = conversations.filter("conv_id IS NOT NULL")
    nodes = rows.filter("node_id IS NOT NULL")
    scope = F.concat_ws("/", "conv_id", "node_id") if scoped_nodes else F.col("node_id")
    nodes = nodes.withColumn("node_source_id", scope).withColumn(
        "node_oid", ids.object_id(F.lit(NODE), F.col("node_source_id"))
    ).withColumn("conv_oid", ids.object_id(F.lit(CONVERSATION), F.col("conv_id")))
    linked = resolve_parents(nodes)
    parents = linked.select("ordinal", "conv_id", "node_id", "parent_key", F.col("node_oid").alias("child_id"), "parent_id", "parent_missing")
    messages = nodes.filter("message_id IS NOT NULL").withColumn(
        "message_oid", ids.object_id(F.lit(MESSAGE), F.col("message_id"))
    )
    place = F.concat(F.col("raw_uri"), F.lit("#conversation="), F.col("conv_id"))
    node_place = F.concat(place, F.lit("&node="), F.col("node_id"))
    none = F.lit(None).cast("string")

    parts = [
        known.select(
            ids.object_id(F.lit(CONVERSATION), F.col("conv_id")).alias("object_id"),
            F.lit("chatgpt_conversation").alias("object_type"),
            F.lit(CONVERSATION).alias("source"), F.col("conv_id").alias("source_id"),
            unix_to_iso(F.col("create_time")).alias("occurred_at"), none.alias("parent_id"),
            place.alias("raw_uri"), "content_hash", none.alias("topic"),
            ordinal(F.col("doc_id"), F.col("conv_pos"), F.lit(0), 0).alias("ordinal"),
        ),
        linked.select(
            F.col("node_oid").alias("object_id"), F.lit("chatgpt_node").alias("object_type"),
            F.lit(NODE).alias("source"), F.col("node_source_id").alias("source_id"),
            unix_to_iso(F.col("message_time")).alias("occurred_at"), "parent_id",
            node_place.alias("raw_uri"), F.col("node_hash").alias("content_hash"), none.alias("topic"),
            "ordinal",
        ),
        messages.select(
            F.col("message_oid").alias("object_id"), F.concat(F.lit("chatgpt_message_"), "role").alias("object_type"),
            F.lit(MESSAGE).alias("source"), F.col("message_id").alias("source_id"),
            unix_to_iso(F.col("message_time")).alias("occurred_at"), F.col("node_oid").alias("parent_id"),
            F.concat(node_place, F.lit("&message="), F.col("message_id")).alias("raw_uri"),
            F.col("message_hash").alias("content_hash"), F.col("content_type").alias("topic"),
            ordinal(F.col("doc_id"), F.col("conv_pos"), F.col("node_pos"), 2).alias("ordinal"),
        ),
    ]
    objects = parts[0].unionByName(parts[1]).unionByName(parts[2])

    edges = nodes.select(
        F.lit("conversation_contains_node").alias("relation_type"),
        F.col("conv_oid").alias("from_object_id"), F.col("node_oid").alias("to_object_id"),
    ).unionByName(messages.select(
        F.lit("node_contains_message").alias("relation_type"),
        F.col("node_oid").alias("from_object_id"), F.col("message_oid").alias("to_object_id"),
    ))
    return ConversationImport(objects, edges, parents, _diagnostics(conversations, known, nodes, parents))


def resolve_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with the parent they name inside their own conversation.

    ``parent_missing`` tells a parent that is not there from a root. A parent of very
    many nodes only repeats on the left side of the join, which may be split.
    """
    key = ["doc_id", "conv_pos", "parent_key"]
    there = nodes.select("doc_id", "conv_pos", F.col("node_id").alias("parent_key"), F.col("node_oid").alias("parent_id"))
    return nodes.join(there, key, "left").withColumn(
        "ordinal", ordinal(F.col("doc_id"), F.col("conv_pos"), F.col("node_pos"), 1)
    ).withColumn("parent_missing", F.col("parent_key").isNotNull() & F.col("parent_id").isNull())


def _diagnostics(conversations: DataFrame, known: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    def rows(df: DataFrame, code: str, source_id, detail) -> DataFrame:
        return df.select(F.lit("warning").alias("severity"), F.lit(code).alias("code"),
                         source_id.cast("string").alias("source_id"), detail.alias("detail"))

    text = F.lit
    parts = [
        rows(conversations.filter("mapping_state = 'unreadable' AND conv_pos IS NULL"), "document_unreadable", F.col("raw_uri"),
             text("Neither a list of conversations nor an object that holds one")),
        rows(conversations.filter("mapping_state = 'unreadable' AND conv_pos IS NOT NULL"), "conversation_unreadable", F.col("raw_uri"),
             F.concat(text("No JSON, or beyond the size that can be parsed: conversation "), F.col("conv_pos").cast("string"),
                      text(" of document "), F.col("doc_id").cast("string"))),
        rows(conversations.filter("conv_id IS NULL AND mapping_state <> 'unreadable'"), "conversation_missing_id", F.lit(None),
             text("Conversation was skipped because it has no id")),
        rows(known.filter("mapping_state = 'invalid'"), "invalid_mapping", F.col("conv_id"),
             text("Conversation mapping is not an object and was skipped")),
        rows(nodes.filter("NOT is_object"), "invalid_node", F.col("node_id"),
             text("Mapping node is not an object; an empty structural node was indexed")),
        rows(nodes.filter("has_message AND message_id IS NULL"), "message_missing_id", F.col("node_id"),
             text("Message was skipped because it has no native id")),
        rows(nodes.filter(F.col("message_id").isNotNull() & F.col("content_type").isin(*UNNORMALISED)),
             "content_not_normalized", F.col("message_id"),
             F.concat(text("Content type '"), "content_type", text("' is preserved in the source but not normalized"))),
        rows(nodes.filter("message_id IS NOT NULL AND has_attachments"), "attachments_not_indexed", F.col("message_id"),
             text("Message attachments remain in the source and are not indexed yet")),
        rows(parents.filter("parent_missing"), "missing_parent", F.col("node_id"),
             F.concat(text("Parent node '"), "parent_key", text("' is absent from the conversation mapping"))),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def import_outcomes(imported: ConversationImport, stored: DataFrame, **hot) -> DataFrame:
    """Outcome of every delivered object: content decides, order of the export counts."""
    incoming = imported.objects.withColumn("fingerprint", F.col("content_hash"))
    known = stored.withColumn("fingerprint", F.col("content_hash"))
    return classify(incoming, known, **{"chunk_span": DOCS_PER_CHUNK, **hot})


def edge_outcomes(imported: ConversationImport, stored_relations: DataFrame, ids: IdSpace = DEFAULT_IDS) -> DataFrame:
    """Outcome per delivered relation, parent edges included."""
    key = ["relation_type", "from_object_id", "to_object_id"]
    delivered = imported.edges.groupBy(*key).agg(F.count("*").alias("n"))
    known = stored_relations.select(*key, F.lit(True).alias("_known"))
    contained = delivered.join(known, key, "left").select(
        *key, F.when(F.col("_known"), "unchanged").otherwise("inserted").alias("outcome"), "n"
    )
    stored_parents = stored_relations.filter("relation_type = 'node_parent'").select(
        F.col("to_object_id").alias("child_id"), F.col("from_object_id").alias("parent_id")
    )
    parents = merge_parent_edges(stored_parents, imported.parents.select("child_id", "parent_id", "ordinal"))
    return contained.unionByName(parents.select(
        F.lit("node_parent").alias("relation_type"), F.col("parent_id").alias("from_object_id"),
        F.col("child_id").alias("to_object_id"), "outcome", F.lit(1).cast("long").alias("n"),
    )).withColumn("relation_id", ids.relation_id(F.col("relation_type"), F.col("from_object_id"), F.col("to_object_id")))


def next_relations(stored_relations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The relation table after the import."""
    removed = outcomes.filter("outcome = 'removed'").select("relation_id")
    kept = stored_relations.join(removed, "relation_id", "left_anti")
    fresh = outcomes.filter("outcome = 'inserted'").select("relation_id", "relation_type", "from_object_id", "to_object_id")
    return kept.unionByName(insert_absent(kept, fresh, ["relation_id"]), allowMissingColumns=True)


def import_stats(outcomes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Counters by kind and outcome: objects per source, relations per type, warnings per code."""
    # A new edge delivered several times is inserted once and unchanged afterwards.
    again = edges.filter("outcome = 'inserted' AND n > 1").select(
        "relation_type", F.lit("unchanged").alias("outcome"), (F.col("n") - 1).alias("n")
    )
    once = edges.select("relation_type", "outcome", F.when(F.col("outcome") == "inserted", 1).otherwise(F.col("n")).alias("n"))
    parts = [
        outcomes.groupBy(F.col("source").alias("kind"), "outcome").agg(F.count("*").alias("n")),
        once.unionByName(again).groupBy(F.col("relation_type").alias("kind"), "outcome").agg(F.sum("n").alias("n")),
        diagnostics.groupBy(F.lit("warning").alias("kind"), F.col("code").alias("outcome")).agg(F.count("*").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MODEL = "keepsake-importer-1"


def _merged_objects(stored: DataFrame, outcomes: DataFrame, parents: DataFrame) -> DataFrame:
    """Objects after the import: nodes hang where they were last delivered, others where first."""
    merged = apply_outcomes(stored, outcomes, [name for name in stored.columns if name in outcomes.columns])
    before = stored.select("object_id", F.col("parent_id").alias("_old"), F.lit(True).alias("_stored"), *[
        F.col(name).alias(f"_{name}") for name in ("event_id", "confidence")])
    decided = latest(parents, ["child_id"], F.col("ordinal"), ["parent_id"]).select(
        F.col("child_id").alias("object_id"), F.col("parent_id").alias("_new"), F.lit(True).alias("_node"))
    joined = merged.join(before, "object_id", "left").join(decided, "object_id", "left")
    parent = F.when(F.col("_node"), F.col("_new")).when(F.col("_stored"), F.col("_old")).otherwise(F.col("parent_id"))
    return joined.withColumn("parent_id", parent).withColumn("event_id", F.col("_event_id")).withColumn("confidence", F.col("_confidence"))


def _source_hash(objects: DataFrame) -> str:
    """One hash of all conversations of an import, in any order, from the hashes they have."""
    number = F.conv(F.substring("content_hash", 1, 15), 16, 10).cast("decimal(20,0)")
    row = objects.filter(F.col("source") == CONVERSATION).agg(F.count("*").alias("n"), F.sum(number).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()


def import_conversations(documents: DataFrame, log: SnapshotLog, raw_uri: str, at: str, import_id: str,
                         ids: IdSpace = DEFAULT_IDS, scoped_nodes: bool = True, strict: bool = True, lines: bool = False, **hot) -> Snapshot:
    """Import an export into an archive: objects, versions, relations, diagnostics and run row, or nothing.

    ``documents`` as ``read_exports`` gives them, ``at`` the time of the import. Stored rows
    are read and rewritten only in the buckets of delivered keys. The same export twice
    changes no table but the run log and the diagnostics. If another job commits in between,
    ``CommitConflict`` is raised, the run is failed, and the archive is as that job left it.
    """
    batch = read_import(documents, ids, scoped_nodes, strict, lines)
    # Every step below reads them, so ids are hashed and parents joined once.
    batch = replace(batch, objects=materialise(batch.objects, "import-objects"), parents=materialise(batch.parents, "import-parents"),
                    edges=materialise(batch.edges, "import-contained"))
    row = {"import_id": import_id, "source": "chatgpt", "raw_uri": raw_uri, "source_hash": _source_hash(batch.objects), "started_at": at, "completed_at": at}
    with log.run(row | {"completed_at": None}) as started:
        base = log.current()
        near = {"objects": log.touched("objects", batch.objects), "object_versions": log.touched("object_versions", batch.objects)}
        ends = batch.edges.select("to_object_id").unionByName(batch.parents.select(F.col("child_id").alias("to_object_id")))
        near["relations"] = log.touched("relations", ends)
        stored = {name: log.read(name, base, buckets) for name, buckets in near.items()}

        outcomes = materialise(
            import_outcomes(batch, stored["objects"], **hot).withColumns({
                "captured_at": F.lit(at), "created_at": F.lit(at), "mime_type": F.lit("application/json"),
                "metadata_json": F.lit("{}"), "import_id": F.lit(import_id)}), "import-outcomes")
        edges = materialise(edge_outcomes(batch, stored["relations"], ids), "import-edges")
        stats = {f"{r['kind']}.{r['outcome']}": r["n"] for r in import_stats(outcomes, edges, batch.diagnostics).collect()}

        staged = {"objects": _merged_objects(stored["objects"], outcomes, batch.parents)}
        versions = stored["object_versions"].unionByName(append_versions(stored["object_versions"], outcomes, **{"chunk_span": DOCS_PER_CHUNK, **hot}), allowMissingColumns=True)
        nodes = staged["objects"].filter(F.col("source") == NODE)
        staged["object_versions"] = mirror_parents(versions.select(*stored["object_versions"].columns), nodes)
        fresh = F.col("created_at").isNull()
        staged["relations"] = next_relations(stored["relations"], edges).withColumns({
            "confidence": F.when(fresh, 1.0).otherwise(F.col("confidence")), "model_id": F.when(fresh, MODEL).otherwise(F.col("model_id")),
            "created_at": F.coalesce("created_at", F.lit(at))})
        notes = batch.diagnostics.withColumns({"import_id": F.lit(import_id), "created_at": F.lit(at)})

        replaced = {name: (near[name], log.stage(name, rows)) for name, rows in staged.items()}
        appended = {"import_diagnostics": log.stage("import_diagnostics", notes)}
        done = started | {"status": "complete", "completed_at": at, "stats_json": json.dumps(stats, sort_keys=True)}
        return log.commit(base, replaced, appended, label=import_id, run=done)
