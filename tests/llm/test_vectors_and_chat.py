"""Vectors and conversations against brute force, components, and the pipeline."""

import collections
import math
import random

import numpy as np
import pytest

from keepsake.llm import chat, components, vectors
from keepsake.llm.common import Scratch


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(90, 90)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.connected(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert components.connected(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).isEmpty()


def brute(rows, threshold=0.95):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            unit[k] = np.array(v) / np.linalg.norm(v)
    links = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= threshold] for k in unit}
    return links


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=32)
        rows.append((len(rows), base.tolist()))
        for _ in range(30 if k == 0 else k % 3):
            rows.append((len(rows), (base + rng.normal(size=32) * 0.1).tolist()))
    rows += [(900, None), (901, [0.0] * 32), (902, [math.nan] * 32), (903, [1.0, None]), (904, [math.inf] + [1.0] * 31), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    rows += [rows[0], (None, rows[0][1]), (0, [3.0, -1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "object_id long, embedding array<double>, n_links int")
    got = collections.Counter((r.object_id, r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect())
    links = brute(rows)
    want = collections.Counter()
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want[i, len(links.get(k, [])), min(ids) if ids else None] += 1
    # Close pairs lie well above the threshold here, so none is missed.
    assert got == want
    assert vectors.near_vectors(frame.filter("false")).isEmpty()


@pytest.mark.parametrize("n", [10, 10_000, 10_000_000])
def test_calibration_reaches_recall_at_the_threshold(n):
    plan = vectors.calibrate(n)
    rng = np.random.default_rng(n)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(400, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    lines = vectors._directions(64, 1, plan.tables * plan.per_table)
    shift = np.random.default_rng([2, 64]).random(plan.tables * plan.per_table)
    cell = lambda x: np.floor(x @ lines / vectors.CELL + shift).reshape(len(x), plan.tables, plan.per_table)
    dealt = (cell(a) == cell(b)).all(axis=2).any(axis=1)
    count = vectors._directions(64, 3, vectors.COUNTED)
    passed = (np.abs(a @ count - b @ count) <= plan.window).sum(axis=1) >= plan.count
    assert (dealt & passed).mean() >= 0.9


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b"), (1, 0, "system", None), (1, 1, "assistant", "a<part>\\l"),
        (1, 3, "user", ""), (1, 3, "user", ""), (2, None, None, "no role"), (2, 5, "odd:#role\n", "x"), (None, 0, "assistant", "nobody's"),
        (3, 0, "assistant", "long " * 50_000),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, ordinal long, role string, text string, formatted string")
    formatted = chat.format_conversations(frame)
    from pyspark.sql import functions as F

    out = {r.conv_id: r for r in chat.read_conversations(formatted).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    key = lambda r: ((r[1] is not None, r[1]), r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=key)
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert out[conv].loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert out[1].formatted.count(chat.OPEN) == 3  # adjacent turns of a role share one mark
    assert chat.format_conversations(frame.filter("false")).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "the house of the rising sun", None, None, 5), (None, None, None, None, None)], docs.schema)
    for table in (docs.unionByName(odd).unionByName(docs.limit(3)).selectExpr("*", "1 AS object_id", "2 AS text_key"), docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            before = table.count()
            out = stage(spark, table, sf)
            assert tuple(out.columns) == pipeline.COLUMNS, name
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            table = spark.read.parquet(str(tmp_path / name))
            assert table.count() <= before
            if name in ("line_dedup", "substring_dedup"):
                assert table.count() == before
        packed = pipeline.STAGES[-1][1](spark, table, sf)
        assert packed.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
