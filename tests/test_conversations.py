"""Conversation import on a small export: counts, repeats, changes, reverts, diagnostics."""

import json

import pytest

from keepsake.contracts import TABLES
from keepsake.operators.upsert import append_versions, apply_outcomes
from keepsake.plans import conversations as plan
from keepsake.sources.conversations import read_exports, scan_conversations
from pyspark.sql import functions as F

OBJECTS = "object_id string, object_type string, source string, source_id string, content_hash string"
VERSIONS = "object_id string, content_hash string, version bigint"


def message(identity, text, **extra):
    return {"id": identity, "author": {"role": "user"}, "create_time": 1700000000.5, "content": {"content_type": "text", "parts": [text]}, **extra}


def export(text="hello"):
    return [{"conversation_id": "c1", "title": "t", "create_time": 1700000000, "mapping": {
        "root": {"id": "root", "parent": None, "children": ["a"], "message": None},
        "a": {"id": "a", "parent": "root", "children": ["b"], "message": message("m1", text)},
        "b": {"id": "b", "parent": "a", "children": [], "message": message("m2", "reply")},
    }}]


def documents(spark, *payloads):
    rows = [(i, f"file:///{i}.json", json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "doc_id bigint, raw_uri string, body string")


class Archive:
    def __init__(self, spark):
        self.spark = spark
        self.objects = spark.createDataFrame([], OBJECTS)
        self.versions = spark.createDataFrame([], VERSIONS)
        self.relations = spark.createDataFrame([], "relation_id string, relation_type string, from_object_id string, to_object_id string")

    def run(self, payload, **options):
        batch = plan.read_import(documents(self.spark, payload), **options)
        outcomes = plan.import_outcomes(batch, self.objects)
        edges = plan.edge_outcomes(batch, self.relations)
        stats = {(r["kind"], r["outcome"]): r["n"] for r in plan.import_stats(outcomes, edges, batch.diagnostics).collect()}
        freeze = lambda df: self.spark.createDataFrame(df.collect(), df.schema)
        new = append_versions(self.versions, outcomes).select("object_id", "content_hash", "version")
        self.versions, objects = freeze(self.versions.unionByName(new)), freeze(apply_outcomes(self.objects, outcomes, self.objects.columns))
        self.relations, self.objects = freeze(plan.next_relations(self.relations, edges)), objects
        return stats

    def total(self, stats, outcome, kinds):
        return sum(n for (kind, o), n in stats.items() if o == outcome and kind in kinds)


SOURCES = {plan.CONVERSATION, plan.NODE, plan.MESSAGE}
EDGES = {"conversation_contains_node", "node_contains_message", "node_parent"}


def test_import_repeat_change_revert(spark):
    archive = Archive(spark)
    stats = archive.run(export())
    assert archive.total(stats, "inserted", SOURCES) == 6 and archive.total(stats, "inserted", EDGES) == 7
    assert stats[("conversation_contains_node", "inserted")] == 3 and stats[("node_parent", "inserted")] == 2
    assert archive.versions.count() == 6
    stats = archive.run(export())
    assert archive.total(stats, "unchanged", SOURCES) == 6 and archive.total(stats, "unchanged", EDGES) == 7
    assert archive.total(stats, "removed", EDGES) == 0 and archive.versions.count() == 6
    stats = archive.run(export("edited"))
    assert archive.total(stats, "changed", SOURCES) == 3 and archive.total(stats, "unchanged", SOURCES) == 3
    assert archive.versions.count() == 9
    stats = archive.run(export())
    assert archive.total(stats, "changed", SOURCES) == 3 and archive.versions.count() == 9


def test_moved_node_loses_its_old_parent(spark):
    archive = Archive(spark)
    archive.run(export())
    moved = export()
    moved[0]["mapping"]["b"]["parent"] = "root"
    stats = archive.run(moved)
    assert stats[("node_parent", "removed")] == 1 and stats[("node_parent", "inserted")] == 1
    assert archive.relations.count() == 7


def test_diagnostics(spark):
    payload = export()
    mapping = payload[0]["mapping"]
    mapping["a"]["message"]["content"]["content_type"] = "reasoning_recap"
    mapping["a"]["message"]["metadata"] = {"attachments": [{"id": "f"}]}
    mapping["b"]["parent"] = "nowhere"
    found = plan.read_import(documents(spark, payload)).diagnostics.collect()
    assert sorted(row["code"] for row in found) == ["attachments_not_indexed", "content_not_normalized", "missing_parent"]


def test_roots_and_odd_shapes(spark):
    wrapped = {"conversations": export() + [7, {"title": "no id"}, {"id": "c2", "mapping": [1]}, {"id": "c3", "mapping": {"n": 5}}]}
    batch = plan.read_import(documents(spark, wrapped))
    codes = sorted(row["code"] for row in batch.diagnostics.collect())
    assert codes == ["conversation_missing_id", "invalid_mapping", "invalid_node"]
    assert batch.objects.filter(F.col("source") == plan.CONVERSATION).count() == 3


def test_other_documents_are_errors(spark):
    with pytest.raises(Exception, match="not a conversation export"):
        plan.read_import(documents(spark, {"chats": []}))


def test_same_node_key_in_two_conversations(spark):
    second = export()
    second[0]["conversation_id"] = "c9"
    payload = export() + second
    scoped = plan.read_import(documents(spark, payload)).objects.filter(F.col("source") == plan.NODE)
    shared = plan.read_import(documents(spark, payload), scoped_nodes=False).objects.filter(F.col("source") == plan.NODE)
    assert scoped.select("object_id").distinct().count() == 6 and shared.select("object_id").distinct().count() == 3


def test_repeated_message_in_one_batch_last_wins(spark):
    payload = export()
    payload[0]["mapping"]["b"]["message"] = message("m1", "second text")
    batch = plan.read_import(documents(spark, payload))
    outcomes = plan.import_outcomes(batch, spark.createDataFrame([], OBJECTS), hot_rows=2, chunk_span=1)
    rows = outcomes.filter("source_id = 'm1'").orderBy("ordinal").collect()
    assert [row["outcome"] for row in rows] == ["inserted", "changed"]


def test_read_exports_from_files(spark, tmp_path):
    (tmp_path / "export.json").write_text(json.dumps(export(), indent=2), encoding="utf-8")
    docs = read_exports(spark, str(tmp_path))
    assert plan.read_import(docs).objects.count() == 6


def test_files_are_numbered_in_path_order_and_lines_in_theirs(spark, tmp_path):
    for name in ("b.json", "a.json", "c d.json"):
        (tmp_path / name).write_text(json.dumps(export(name)), encoding="utf-8")
    rows = read_exports(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [row["raw_uri"].rsplit("/", 1)[1] for row in rows] == ["a.json", "b.json", "c%20d.json"]
    lines = tmp_path / "lines"
    lines.mkdir()
    items = [json.dumps({**export()[0], "conversation_id": f"c{i}"}) for i in range(5)]
    (lines / "x.jsonl").write_text("\n".join(items[:3] + ["", "{broken"] + items[3:]), encoding="utf-8")
    batch = plan.read_import(read_exports(spark, str(lines), lines=True), lines=True)
    found = batch.objects.filter(F.col("source") == plan.CONVERSATION).orderBy("ordinal").collect()
    assert [row["source_id"] for row in found] == [f"c{i}" for i in range(5)]
    assert [row["code"] for row in batch.diagnostics.collect()] == ["conversation_unreadable"]


def test_order_of_large_document_keys_and_positions(spark):
    """The last delivery wins for any document key and more conversations than 18 bits hold."""
    rows = [(key, f"file:///{key}.json", json.dumps(export(f"text {key}"))) for key in (1, 1 << 21, 1 << 22, (1 << 33) + 1, 1 << 62)]
    docs = spark.createDataFrame(rows, "doc_id bigint, raw_uri string, body string")
    outcomes = plan.import_outcomes(plan.read_import(docs), spark.createDataFrame([], OBJECTS))
    wanted = plan.read_import(docs.filter(F.col("doc_id") == 1 << 62)).objects.filter("source_id = 'm1'").first()["content_hash"]
    assert apply_outcomes(spark.createDataFrame([], OBJECTS), outcomes, ["object_id", "object_type", "source", "source_id", "content_hash"]).filter("source_id = 'm1'").first()["content_hash"] == wanted
    many = (1 << 18) + 1
    body = "[" + ",".join('{"id":"same","n":%d}' % i for i in range(many)) + "]"
    docs = spark.createDataFrame([(0, "u", body), (1, "v", '[{"id":"same","n":-1}]')], "doc_id bigint, raw_uri string, body string")
    batch = plan.read_import(docs)
    assert batch.objects.select("ordinal").distinct().count() == many + 1
    outcomes = plan.import_outcomes(batch, spark.createDataFrame([], OBJECTS), hot_rows=100, chunk_span=1)
    assert {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()} == {"inserted": 1, "changed": many}


def test_large_documents_are_cut_exactly(spark):
    """Documents beyond the size of a whole parse say the same, and none is lost."""
    wrapped = {"first": [1], "conversations": export() + [7, {"id": "c2", "mapping": {"n": {"x": 1.50}}}], "last": {"a": "]"}}
    docs = documents(spark, wrapped, export("other \u00e9 \" ]"), [])
    columns = ["doc_id", "conv_pos", "conv_id", "content_hash", "mapping_state"]
    whole = scan_conversations(docs).select(*columns)
    cut = scan_conversations(docs, whole_bytes=1).select(*columns)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 3
    bad = documents(spark, {"chats": []}, export(), "text").unionByName(
        spark.createDataFrame([(9, "file:///9.json", "[{]"), (10, "file:///10.json", None)], docs.schema))
    for limit in (1, 1 << 20):
        states = {r["doc_id"]: r["mapping_state"] for r in scan_conversations(bad, strict=False, whole_bytes=limit).collect()}
        assert states == {0: "unreadable", 1: "object", 2: "unreadable", 9: "unreadable", 10: "unreadable"}
        with pytest.raises(Exception, match="not a conversation export"):
            scan_conversations(bad, whole_bytes=limit).collect()


def test_conversation_beyond_the_parser_is_named(spark):
    body = json.dumps(export())[:-1] + ', {"id": "long", "text": "' + "x" * 20_100_000 + '"}]'
    for strict in (True, False):
        batch = plan.read_import(spark.createDataFrame([(0, "file:///a", body)], "doc_id bigint, raw_uri string, body string"), strict=strict)
        assert [r["code"] for r in batch.diagnostics.collect()] == ["conversation_unreadable"] and batch.objects.count() == 6


def test_last_of_repeated_keys_counts(spark):
    docs = spark.createDataFrame([(0, "u", '[{"id": "a", "id": "b"}]')], "doc_id bigint, raw_uri string, body string")
    assert [r["conv_id"] for r in scan_conversations(docs).collect()] == ["b"]


def test_unreadable_documents_are_diagnosed(spark):
    batch = plan.read_import(documents(spark, {"chats": []}, export()), strict=False)
    assert [(r["code"], r["source_id"]) for r in batch.diagnostics.collect()] == [("document_unreadable", "file:///0.json")]
    assert batch.objects.count() == 6


def test_malformed_documents_are_read_alike_at_any_size(spark):
    good = '{"id": "a", "mapping": {}}'
    bad = [f'[{good}, {{"id": "b", "create_time": NaN}}]', f'{{"x": -Infinity, "conversations": [{good}]}}']
    ended = [f"[{good}] x", f'{{"conversations": [{good}]}} []']
    docs = spark.createDataFrame([(k, f"file:///{k}", body) for k, body in enumerate(bad + ended)], "doc_id bigint, raw_uri string, body string")
    for limit in (1, 20_000_000):
        found = sorted((r["doc_id"], r["mapping_state"]) for r in scan_conversations(docs, strict=False, whole_bytes=limit).collect())
        assert found == [(0, "unreadable"), (1, "unreadable"), (2, "object"), (3, "object")], limit


def test_trailing_commas_are_refused_at_any_size(spark):
    good = '{"id": "a", "mapping": {}}'
    bad = [f"[{good},]", f'{{"conversations": [{good},]}}', f'{{"conversations": [{good}],}}', f'[{good}, {{"id": "b",}}]']
    docs = spark.createDataFrame([(k, f"file:///{k}", body) for k, body in enumerate(bad)], "doc_id bigint, raw_uri string, body string")
    for limit in (1, 20_000_000):
        found = scan_conversations(docs, strict=False, whole_bytes=limit)
        assert [(r["conv_pos"], r["mapping_state"]) for r in found.collect()] == [(None, "unreadable")] * 4, limit


def test_each_file_is_opened_once(spark, tmp_path):
    good = '{"id": "%s", "mapping": {}}'
    (tmp_path / "small.json").write_text(f"[{good % 'a'}]")
    (tmp_path / "large.json").write_text(f"[{good % 'b'}, {good % 'c'}]" + " " * 300)
    found = scan_conversations(read_exports(spark, str(tmp_path)), whole_bytes=200)
    assert sorted(r["conv_id"] for r in found.collect()) == ["a", "b", "c"]
    parts = [scan_conversations(read_exports(spark, str(tmp_path)).filter(f"size {sign} 200"), whole_bytes=200) for sign in ("<=", ">")]
    assert [sorted(r["conv_id"] for r in part.collect()) for part in parts] == [["a"], ["b", "c"]]
