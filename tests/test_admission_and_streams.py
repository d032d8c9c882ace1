"""Admission equals the row-by-row rule however it is cut; streams equal batches."""

import os
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from keepsake.operators import admission
from keepsake.operators.admission import replay_admission
from keepsake.streaming import ingest as stream
from keepsake.streaming.admission import admit_stream


def by_rule(rows, limit, window):
    seen, admitted = defaultdict(deque), {}
    for request, principal, stamp in sorted(rows, key=lambda r: (r[2], r[0])):
        times = seen[principal]
        while times and times[0] <= stamp - window:
            times.popleft()
        admitted[request] = len(times) < limit
        if admitted[request]:
            times.append(stamp)
    return admitted


def test_saturated_principal_in_many_chunks(spark):
    rng = random.Random(7)
    second = 1_000_000
    rows = [(i, "hot", rng.randrange(600) * second) for i in range(400)]
    rows += [(1000 + i, f"p{i % 5}", rng.randrange(4000) * second) for i in range(100)]
    df = spark.createDataFrame(rows, "request_id bigint, principal string, stamp bigint")
    got = replay_admission(df, 3, 45, chunk_stamps=40)
    assert {r["request_id"]: r["admitted"] for r in got.collect()} == by_rule(rows, 3, 45 * second)


@pytest.mark.parametrize("gap", [7, 0])
def test_rounds_are_bounded_for_a_saturated_principal(spark, monkeypatch, gap):
    """Twenty chunks and more, all saturated: random gaps fade, regular ones keep their phase."""
    rng = random.Random(9)
    rounds = []
    played = admission._played
    monkeypatch.setattr(admission, "_played", lambda rows, limit, window, walk=False: rounds.append(walk) or played(rows, limit, window, walk))
    second = 1_000_000
    # A burst first, so that the phase of the admitted times differs from that of an empty start.
    stamps = [0, 0, 3 * second] + [5 * second + i * 10 * second + (rng.randrange(gap) * second if gap else 0) for i in range(900)]
    rows = [(i, "hot", stamp) for i, stamp in enumerate(stamps)] + [(5000 + i, f"p{i % 5}", i * second) for i in range(50)]
    df = spark.createDataFrame(rows, "request_id bigint, principal string, stamp bigint").repartition(3)
    got = replay_admission(df, 3, 45, chunk_stamps=40)
    assert {r["request_id"]: r["admitted"] for r in got.collect()} == by_rule(rows, 3, 45 * second)
    assert len(rounds) - 1 <= 3  # one pass more for the cold principals


def test_equal_stamps_null_principals_and_no_rows(spark):
    rows = [(i, "a" if i % 2 else None, (i // 8) * 1_000_000) for i in range(64)]
    df = spark.createDataFrame(rows, "request_id bigint, principal string, stamp bigint")
    got = {r["request_id"]: r["admitted"] for r in replay_admission(df, 3, 2, chunk_stamps=5).collect()}
    assert {k: v for k, v in got.items() if k % 2} == by_rule([r for r in rows if r[1]], 3, 2_000_000)
    assert replay_admission(df.limit(0), 3, 2).collect() == []
    assert not any(r["admitted"] for r in replay_admission(df, 0, 2).collect())


def test_skipping_replay_equals_the_rule():
    rng = random.Random(2)
    for _ in range(200):
        limit, window = rng.randrange(1, 5), rng.randrange(1, 40)
        stamps = sorted(rng.sample(range(300), rng.randrange(1, 120)))
        counts = [rng.randrange(1, 4) for _ in stamps]
        state = sorted(rng.randrange(-30, 0) for _ in range(rng.randrange(limit + 1)))
        admitted, expected = deque(state), []
        for stamp, count in zip(stamps, counts):
            while admitted and admitted[0] <= stamp - window:
                admitted.popleft()
            free = min(count, limit - len(admitted))
            admitted.extend([stamp] * free)
            expected.append(free)
        got, after = admission.replay(stamps, counts, state, limit, window)
        alive = lambda times: [t for t in times if t > stamps[-1] - window]
        assert got == expected and alive(after) == alive(admitted)


def test_limit_one_rejects_the_second(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "a", 60_000_000)], "request_id bigint, principal string, stamp bigint")
    assert {r["request_id"]: r["admitted"] for r in replay_admission(df, 1, 60).collect()} == {1: True, 2: False, 3: True}


def test_admission_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, "a" if i % 3 else "b", 1_700_000_000 + 7 * i) for i in range(40)]
    known = set()
    for part in range(2):
        df = spark.createDataFrame(rows[part * 20:(part + 1) * 20], "request_id bigint, principal string, s bigint")
        df.select("request_id", "principal", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
        for path in set(source.glob("part-*")) - known:
            # Files are taken in the order of their times.
            os.utime(path, (1_700_000_000 + part * 60, 1_700_000_000 + part * 60))
            known.add(path)
    incoming = spark.readStream.schema("request_id bigint, principal string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (admit_stream(incoming, 2, 60).writeStream.format("memory").queryName("admitted").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r["request_id"]: r["admitted"] for r in spark.table("admitted").collect()}
    assert got == by_rule([(i, p, s * 1_000_000) for i, p, s in rows], 2, 60_000_000)


def test_late_requests_get_a_decision(spark, tmp_path):
    source = tmp_path / "in"
    start = 1_700_000_000
    parts = [[(1, "a", 0), (2, "a", 500), (3, "b", 900)], [(4, "a", 100), (5, "a", 839), (6, "b", 841), (7, "c", 10), (8, "a", 905)]]
    for part, rows in enumerate(parts):
        before = set(source.glob("part-*"))
        df = spark.createDataFrame([(i, p, start + s) for i, p, s in rows], "request_id bigint, principal string, s bigint")
        df.select("request_id", "principal", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
        for path in set(source.glob("part-*")) - before:
            os.utime(path, (start + part * 60, start + part * 60))
    incoming = spark.readStream.schema("request_id bigint, principal string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    (admit_stream(incoming, 1, 400).writeStream.format("memory").queryName("with_late").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r["request_id"]: (r["admitted"], r["late"]) for r in spark.table("with_late").collect()}
    # The watermark of the second micro-batch stands at 840.
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True), 5: (False, True), 6: (False, False), 7: (False, True), 8: (True, False)}


def test_ingest_stream_equals_row_by_row_and_replays(spark, tmp_path):
    schema = ("ordinal bigint, object_type string, source string, source_id string, raw_uri string, content binary, "
              "occurred_at string, captured_at string, mime_type string, metadata_json string")

    def item(n, key, content):
        return (n, "photo", "s", key, f"file:///{key}", content, None, "2025-01-01T00:00:00+00:00", "image/jpeg", "{}")

    batches = [[item(0, "a", b"1"), item(1, "b", b"1")], [item(2, "a", b"2"), item(3, "c", b"3")], [item(4, "a", b"1"), item(5, "b", b"1")]]
    root = str(tmp_path / "log")
    for number, rows in enumerate(batches):
        stream.merge_batch(spark.createDataFrame(rows, schema), number, root)
    log = stream.read_log(spark, root)
    assert {r["ordinal"]: r["outcome"] for r in log.collect()} == {0: "inserted", 1: "inserted", 2: "changed", 3: "inserted", 4: "changed", 5: "unchanged"}
    versions = {(r["object_id"], r["version"]) for r in stream.versions_of(log).collect()}
    assert len(versions) == 4
    before = sorted(map(tuple, stream.objects_of(log).collect()), key=str)
    # A batch that runs again after a failure leaves everything as it was.
    stream.merge_batch(spark.createDataFrame(batches[1], schema), 1, root)
    again = stream.read_log(spark, root)
    assert sorted(map(tuple, stream.objects_of(again).collect()), key=str) == before and again.count() == 6


def test_many_batches_equal_one_and_read_only_their_buckets(spark, tmp_path, monkeypatch):
    schema = ("ordinal bigint, object_type string, source string, source_id string, raw_uri string, content binary, "
              "occurred_at string, captured_at string, mime_type string, metadata_json string")
    rng = random.Random(3)
    rows = [(n, "note" if rng.random() < 0.9 else "sheet", "s", f"k{rng.randrange(12)}", "file:///x", bytes([rng.randrange(3)]), None, f"2025-01-01T00:00:{n:02d}+00:00", "text/plain", "{}")
            for n in range(60)]
    read = []
    snapshots = stream.SnapshotLog
    real = snapshots.read
    monkeypatch.setattr(snapshots, "read", lambda self, name, snapshot=None, buckets=None: read.append((name, buckets)) or real(self, name, snapshot, buckets))
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    for number in range(5):
        stream.merge_batch(spark.createDataFrame(rows[number * 12:(number + 1) * 12], schema), number, many, buckets=6, most_parts=2)
    assert all(buckets is not None for _, buckets in read)
    stream.merge_batch(spark.createDataFrame(rows, schema), 0, one, buckets=6)

    def told(root):
        state = stream.state_of(spark, root, 6)
        log = stream.read_log(spark, root)
        outcomes = sorted((r["ordinal"], r["outcome"]) for r in log.collect())
        objects = sorted(map(str, state.read("objects").collect()))
        versions = sorted(map(tuple, state.read("object_versions").collect()))
        rejects = sorted(r["ordinal"] for r in spark.read.parquet(stream.rejects_of(root)).collect())
        # The report over the log says the same as the state.
        assert objects == sorted(map(str, stream.objects_of(log).collect()))
        assert versions == sorted((r["object_id"], r["content_hash"], r["version"]) for r in stream.versions_of(log).collect())
        return outcomes, objects, versions, rejects

    assert told(many) == told(one)
    state = stream.state_of(spark, many, 6)
    assert max(len(parts) for parts in state.current().parts["object_versions"].values()) <= 2
