"""Several tables change at once or not at all; imports and runs on top of that."""

import json

import pytest
from pyspark.sql import functions as F

from keepsake.plans import conversations as plan
from keepsake.sources.snapshots import CommitConflict, SnapshotLog
from tests.test_conversations import documents, export

TABLES = ("objects", "object_versions", "relations", "import_diagnostics")
AT = "2025-01-0{}T00:00:00+00:00"


def state(log, names=TABLES[:3]):
    return {name: sorted(map(str, log.read(name).drop("captured_at").collect())) for name in names}


def load(log, n, payload, **options):
    return plan.import_conversations(documents(log.spark, payload), log, "file:///e", AT.format(n), f"run{n}", **options)


def test_parsed_nodes_are_read_for_objects_parents_and_edges_only(spark, tmp_path, monkeypatch):
    log, read = SnapshotLog(spark, str(tmp_path / "archive"), buckets=7), {}

    def noted(df, label):
        read[label] = any("conversation-nodes" in name for name in df.inputFiles())
        return written(df, label)

    written = plan.materialise
    monkeypatch.setattr(plan, "materialise", noted)
    load(log, 1, export())
    assert {label for label, nodes in read.items() if nodes} == {"import-objects", "import-parents", "import-contained"}
    assert {"import-outcomes", "import-edges"} < set(read)


def test_import_reads_back_and_repeats(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=7)
    assert log.current().seq == 0 and log.read("objects").count() == 0 and log.runs().collect() == []
    load(log, 1, export())
    assert (log.read("objects").count(), log.read("object_versions").count(), log.read("relations").count()) == (6, 6, 7)
    parents = {r.source_id: r.parent_id for r in log.read("objects").collect()}
    ids = {r.source_id: r.object_id for r in log.read("objects").collect()}
    assert parents == {"c1": None, "c1/root": None, "c1/a": ids["c1/root"], "c1/b": ids["c1/a"], "m1": ids["c1/a"], "m2": ids["c1/b"]}
    before = state(log)
    load(log, 2, export())
    assert state(log) == before
    runs = {r.import_id: r for r in log.runs().collect()}
    assert {k: r.status for k, r in runs.items()} == {"run1": "complete", "run2": "complete"}
    assert json.loads(runs["run1"].stats_json)["chatgpt.node.inserted"] == 3 and json.loads(runs["run2"].stats_json)["node_parent.unchanged"] == 2
    assert runs["run1"].source_hash == runs["run2"].source_hash
    assert state(log)["objects"] == sorted(map(str, log.read("objects", log.current(1)).drop("captured_at").collect()))


def test_change_move_and_revert(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    load(log, 1, export())
    moved = export("edited")
    moved[0]["mapping"]["b"]["parent"] = "root"
    load(log, 2, moved)
    ids = {r.source_id: r.object_id for r in log.read("objects").collect()}
    rows = {r.source_id: r for r in log.read("objects").collect()}
    assert rows["c1/b"].parent_id == ids["c1/root"] and rows["c1/b"].created_at == AT.format(1) and rows["c1/b"].captured_at == AT.format(2)
    edges = {(r.from_object_id, r.to_object_id) for r in log.read("relations").filter("relation_type = 'node_parent'").collect()}
    assert edges == {(ids["c1/root"], ids["c1/a"]), (ids["c1/root"], ids["c1/b"])}
    versions = {(r.object_id, r.version): r for r in log.read("object_versions").collect()}
    assert len(versions) == 10  # conversation, a, b and m1 have two each
    assert versions[ids["c1/b"], 2].parent_id == ids["c1/root"] and versions[ids["c1/b"], 1].parent_id == ids["c1/a"]
    assert {r.import_id for r in log.read("object_versions").filter("version = 2").collect()} == {"run2"}
    load(log, 3, export())
    assert log.read("object_versions").count() == 10
    assert {r.source_id: r.parent_id for r in log.read("objects").collect()}["c1/b"] == ids["c1/a"]


def test_a_failing_run_leaves_the_last_snapshot(spark, tmp_path, monkeypatch):
    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=3)
    load(log, 1, export())
    before = state(log, TABLES)
    stage = SnapshotLog.stage

    def broken(self, name, rows):
        if name == "relations":
            raise RuntimeError("disk full")
        return stage(self, name, rows)

    monkeypatch.setattr(SnapshotLog, "stage", broken)
    with pytest.raises(RuntimeError):
        load(log, 2, export("edited"))
    assert state(log, TABLES) == before and log.current().seq == 1
    monkeypatch.setattr(SnapshotLog, "stage", stage)
    monkeypatch.setattr(SnapshotLog, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed: nothing is noted any more
        load(log, 3, export("edited"))
    assert {r.import_id: (r.status, r.error) for r in log.runs().collect()} == {"run1": ("complete", None), "run2": ("failed", "disk full"), "run3": ("running", None)}
    assert state(log, TABLES) == before


def test_one_of_two_writers_wins(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), keys={"t": ("k",)}, schemas={"t": "k string, v bigint"}, buckets=5)
    base = log.current()
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v bigint")
    parts = [log.stage("t", rows) for _ in range(2)]
    log.commit(base, appended={"t": parts[0]})
    with pytest.raises(CommitConflict):
        log.commit(base, appended={"t": parts[1]})
    assert sorted(r.v for r in log.read("t").collect()) == [1, 2, 3]


def test_merges_rewrite_only_touched_buckets_and_old_parts_go(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "archive"), keys={"t": ("k",)}, schemas={"t": "k string, v bigint"}, buckets=16)
    whole = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    first = log.commit(log.current(), appended={"t": log.stage("t", whole)})
    one = whole.filter("k = '17'")
    near = log.touched("t", one)
    assert len(near) == 1
    stored = log.read("t", first, near)
    assert 0 < stored.count() < 200 and len(stored.inputFiles()) < len(log.read("t").inputFiles())
    second = log.commit(first, {"t": (near, log.stage("t", stored.withColumn("v", F.when(F.col("k") == "17", -1).otherwise(F.col("v")))))})
    changed = [key for key in second.parts["t"] if second.parts["t"][key] != first.parts["t"][key]]
    assert changed == [str(near[0])] and log.read("t").agg(F.sum("v")).first()[0] == sum(range(200)) - 18
    third = log.commit(second, {"t": (near, {})})
    assert str(near[0]) not in third.parts["t"]
    for _ in range(3):
        log.commit(log.current(), appended={"t": log.stage("t", one)})
    assert len(log.current().parts["t"][str(near[0])]) == 3
    log.compact("t", 2)
    assert len(log.current().parts["t"][str(near[0])]) == 1 and log.read("t").filter("k = '17'").count() == 3
    rows = log.read("t").count()
    assert log.expire(keep=1) > 0 and log.read("t").count() == rows


def test_metadata_fills_times_of_objects_and_versions(spark, tmp_path):
    from keepsake.plans.metadata import import_metadata

    log = SnapshotLog(spark, str(tmp_path / "archive"), buckets=4)
    known, other = "2020-05-01T10:00:00+00:00", "2021-06-01T10:00:00+00:00"
    rows = [("o1", None, "h1"), ("o2", known, "h2"), ("o3", other, "h3"), ("o4", None, "h4")]
    objects = spark.createDataFrame(rows, "object_id string, occurred_at string, content_hash string").select(
        "*", F.lit("photo").alias("object_type"), F.lit("s").alias("source"), F.col("object_id").alias("source_id"))
    full = lambda df, name: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in log.read(name).dtypes])
    versions = spark.createDataFrame([("o1", 1, "old", None), ("o1", 2, "h1", None), ("o2", 1, "h2", known), ("o3", 1, "h3", other), ("o4", 1, "h4", "1999-01-01T00:00:00+00:00")],
                                     "object_id string, version bigint, content_hash string, occurred_at string")
    attachments = objects.select("object_id", F.concat(F.lit("b-"), "object_id").alias("blob_id"))
    log.commit(log.current(), appended={name: log.stage(name, full(df, name)) for name, df in
                                        {"objects": objects, "object_versions": versions, "attachments": attachments}.items()})
    note = [("photo.gps_missing", "No GPS tags are present")]
    tags = spark.createDataFrame([(o, known, "tags", "partial", note, "{}", "photo.tags@1") for o in ("o1", "o2", "o3", "o4")],
                                 "object_id string, occurred_at string, occurred_at_source string, status string, diagnostics array<struct<code string, detail string>>, metadata_json string, extractor_id string")
    import_metadata(tags, log, AT.format(1), "tags")
    assert {r.object_id: r.occurred_at for r in log.read("objects").collect()} == {"o1": known, "o2": known, "o3": other, "o4": known}
    # The older content knows nothing, and what a version knows it keeps.
    assert {(r.object_id, r.version): r.occurred_at for r in log.read("object_versions").collect()} == {
        ("o1", 1): None, ("o1", 2): known, ("o2", 1): known, ("o3", 1): other, ("o4", 1): "1999-01-01T00:00:00+00:00"}
    assert {r.object_id: (r.status, r.occurred_at) for r in log.read("metadata_extractions").collect()}["o3"] == ("partial", None)
    assert log.read("metadata_diagnostics").filter("code = 'canonical.occurred_at_conflict'").count() == 1
    before = {name: sorted(map(str, log.read(name).collect())) for name in ("objects", "object_versions", "metadata_extractions", "metadata_diagnostics")}
    import_metadata(tags, log, AT.format(2))
    assert before == {name: sorted(map(str, log.read(name).collect())) for name in before}
