"""Suffix-array dedup against brute force, and its parts."""

import random
from collections import Counter

import numpy as np
import pytest

from keepsake.llm import suffixes

SCHEMA = "object_id long, result_text string, segment string, anchor string"


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + least] for t in data for i in range(len(t) - least + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i : i + least] = True
        edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).reshape(-1, 2)
        out.append((len(t), int(gone.sum()), tuple((int(a), int(b)) for a, b in edges), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    junk = lambda n: "".join(r.choice("abcdefghijklmnop éß\n") for _ in range(n))
    shared = [junk(n) for n in (199, 200, 201, 260, 700)]
    out = [None, "", " ", "short", "a" * 199, "a" * 200, "b" * 201, "c" * 9000, "ab" * 400, "\x00" * 300, "é" * 100, "x" + "é" * 100]
    out += [shared[k % 5].join(junk(r.randrange(400)) for _ in range(r.randrange(1, 4))) for k in range(60)]
    out += [shared[4][k : k + 220 + k] for k in range(0, 300, 20)]
    one = junk(3000)
    out += [one] * 4 + [one[:k] + "#" + one[k + 1 :] for k in range(5, 3000, 150)]
    out += [junk(500) + "license " * 60 + junk(100) for _ in range(6)]
    return out


def run(spark, texts, least=200):
    frame = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.object_id: r for r in suffixes.remove_repeated_strings(frame, least).collect()}
    assert len(got) == len(texts)
    want = brute(texts, least)
    for k in range(len(texts)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, tuple(tuple(s) for s in r.spans), bytes(r.kept_bytes)) == want[k], (k, texts[k])
        assert r.n_spans == len(r.spans)


def test_equals_brute_force(spark, texts):
    run(spark, texts)


def test_other_lengths(spark, texts):
    run(spark, texts[:50], 30)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """One passage in many different texts: its anchor has many segments, and several groups."""
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SEGMENT_WINDOWS", 64)
    monkeypatch.setattr(suffixes, "PART_WINDOWS", 300)
    r = random.Random(6)
    junk = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage = junk(230)
    texts = [junk(150) + passage + junk(150) for _ in range(120)]
    texts += [texts[k][:400] for k in range(0, 120, 30)] + [junk(10) + texts[k][40:450] for k in range(1, 60, 7)]
    run(spark, texts)


def test_rows_and_ids(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    rows = [(1, text), (1, text), (None, text[:210]), (None, None), (2, "other " * 10)]
    frame = spark.createDataFrame([(k, t, "", "") for k, t in rows], SCHEMA)
    got = suffixes.remove_repeated_strings(frame).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (60, 0), (210, 210), (250, 250), (250, 250)]
    alone = suffixes.remove_repeated_strings(frame.filter("result_text LIKE 'other%'")).collect()
    assert [(r.object_id, r.n_removed, r.n_spans) for r in alone] == [(2, 0, 0)]
    assert suffixes.remove_repeated_strings(frame.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_expansion_gives_common_prefixes(seed):
    r = random.Random(seed)
    alphabet = (b"ab", b"abc", bytes(range(256)), b"a", b"\x00\xff", b"abcdefgh")[seed]
    segments = [bytes(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    segments += [segments[3][:k] + b"a" for k in range(1, 20)]
    symbols = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in segments]).astype(np.uint16)
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    close = lambda i: int(ends[np.searchsorted(ends, i)])
    suffix = lambda i: (tuple(symbols[i : close(i)]), -1, close(i))
    expected = sorted(range(len(symbols)), key=lambda i: (tuple(symbols[i : close(i)].tolist()) + (0,), i if i == close(i) else close(i)))
    assert suffixes.suffix_order(symbols, ends).tolist() == expected
    for least in (1, 2, 3, 8, 30):
        order, bounds = suffixes.common_prefix_bounds(symbols, ends, least)
        for row in range(1, len(order)):
            a, b = (symbols[i : close(i)].tolist()[:least] for i in (order[row - 1], order[row]))
            assert bounds[row] == (len(a) < least or a != b), (row, a, b)


def test_query_on_whole_table(spark):
    import hashlib

    from keepsake.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {k: w for (k, _), w in zip(docs, brute([t for _, t in docs], 200))}
    got = {r.doc_id: r for r in QUERIES["op12_suffix_array_dedup"](spark, d).collect()}
    assert set(got) == set(want)
    for k, (n, removed, spans, kept) in want.items():
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())
