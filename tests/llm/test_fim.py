"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import random
import re

from keepsake.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "object_id long, result_text string, form string, n_tokens int, pieces string"


def plain_version(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(part) for part in (tokens[:low], tokens[low:high], tokens[high:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases():
    r = random.Random(3)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a b 　c", "<P", "x <S> y", "<M>", "<<P >P> S>", "ä😀\x00 z\x0b\x0c\x1c q", "<" * 9 + " P> <S", "w " * 50_000]
    texts += ["".join(r.choice("ab <>PSM\n\té😀") for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[7], (5, "other text of one id"), (None, "no id has a key too"), (None, None)]


def test_output_and_round_trip(spark):
    given = cases()
    frame = spark.createDataFrame([(k, t, "clash", 1, "clash") for k, t in given], SCHEMA).repartition(3)
    arranged = fim.fill_in_middle(frame)
    restored = fim.restore_texts(arranged)
    rows = arranged.collect()
    order = lambda items: sorted(items, key=repr)
    assert order((r.object_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output_text) for r in rows) == order((k, *plain_version(k, t)) for k, t in given)
    assert all(r.output_sha256 == hashlib.sha256(r.output_text.encode()).hexdigest() for r in rows)
    back = restored.collect()
    assert order((r.object_id, r.result_text) for r in back) == order((k, t or "") for k, t in given)
    assert all(r.text_sha256 == hashlib.sha256(r.result_text.encode()).hexdigest() for r in back)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_pieces_describe_the_output(spark):
    given = [(k, f"one two  three\nfour {k} ö") for k in range(40)]
    for r in fim.fill_in_middle(spark.createDataFrame(given, "object_id long, result_text string")).collect():
        buffers = (dict(given)[r.object_id].encode(), fim.SENTINEL_BYTES)
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output_text.encode()


def test_parameters_and_empty_table(spark):
    frame = spark.createDataFrame([(k, "a b c d") for k in range(50)], "object_id int, result_text string")
    forms = lambda **k: {r.form for r in fim.fill_in_middle(frame, **k).collect()}
    assert forms(fim_percent=0) == {"plain"} and forms(fim_percent=100, spm_percent=0) == {"psm"} and forms(fim_percent=100, spm_percent=100) == {"spm"}
    assert fim.restore_texts(fim.fill_in_middle(frame.limit(0))).collect() == []
    texts = fim.fill_in_middle(spark.createDataFrame([("é", "a b")], "object_id string, result_text string"))
    assert texts.first().object_id == "é"


def test_splitting_descriptors():
    pieces = [(0, 5, 3), (1, 0, 3), (0, 9, 4)]
    for at in range(11):
        before, behind = fim.split(pieces, at)
        spread = lambda items: [(b, s + k) for b, s, n in items for k in range(n)]
        assert spread(before) + spread(behind) == spread(pieces) and len(spread(before)) == at


def test_query_on_whole_table(spark):
    from keepsake.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_fill_in_middle"](spark, d).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        n, form, p, m, output = plain_version(k, docs[k])
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(docs[k] or ""))
