"""What the stages of the pipeline keep, row by row."""

from collections import Counter

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(table):
    return Counter(tuple(r) for r in table.select(*pipeline.COLUMNS).collect())


def test_passages_leave_other_texts_as_they_are(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    whole = [
        (1, f"one\n{passage}", "en", "s", 4 + len(passage)), (3, " a\tb\n\nc  d \r\n", None, "s", 13), (4, "", "en", None, 0),
        (5, " \n ", "en", "s", 3), (6, None, "en", "s", None), (None, "no\n\nid ", "en", "s", 7),
        (7, "\n".join(f"v{i}  x" for i in range(60)), "en", "s", None),
    ]
    whole = [(*r[:4], None if r[1] is None else len(r[1])) for r in whole]
    docs = spark.createDataFrame([*whole, (2, f"two\n\nmore {passage}\ttail", "en", "s", 0)], SCHEMA)
    out = rows(pipeline.substring_dedup(spark, docs, SF))
    assert out == Counter([*whole, (2, "two more tail", "en", "s", 13)])


def test_near_copies_leave_one_row_each(spark):
    word = lambda k: [f"{k}x{i}" for i in range(60)]
    text = lambda k, end="": " ".join([*word(k), *end.split()])
    row = lambda doc_id, text, lang="en", source="s": (doc_id, text, lang, source, len(text))
    groups = [
        [row(1, text("a"))] * 3,  # equal rows
        [row(2, text("b")), row(2, text("b", "near")), row(9, text("b"))],  # a near copy of the same doc_id
        [row(3, text("c"), None, "s"), row(3, text("c"), "s", None), row(3, text("c"), None, None)],
        [row(None, text("d"))],  # without id, a group of its own
        [row(None, text("e")), row(4, text("e")), row(None, text("e", "near"))],
        [row(None, text("f"))] * 2 + [row(None, text("f", "near"))],
        [row(5, text("g"))], [row(5, text("h"))],  # one doc_id, different texts
    ]
    docs = spark.createDataFrame([r for group in groups for r in group], SCHEMA)
    out = rows(pipeline.jaccard_join(spark, docs, SF))
    kept = [[r for r in set(group) for _ in range(out[r])] for group in groups]
    assert [len(k) for k in kept] == [1] * len(groups), kept
    assert sum(out.values()) == len(groups)
    assert [k[0][0] for k in kept] == [1, 2, 3, None, 4, None, 5, 5]


def test_copies_end_as_one_document(spark, tmp_path):
    lines = ["the quick brown fox jumps over the lazy dog", "", "and the old house stood at the end of the road"]
    copies = [(k, "\n".join(lines), None, "s", 0) for k in range(2, 8)]
    parts = [(8, f"{lines[2]}\n\n{lines[0]}", None, "s", 0), (9, "\n".join([lines[0], "nobody has seen this line before today"]), None, "s", 0)]
    table = spark.createDataFrame([*copies, *parts], SCHEMA)
    for name, stage in pipeline.STAGES[1:3]:
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    packed = pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert sorted(r.doc_id for r in packed) == [2, 9]
    assert all(r.length > 1 for r in packed)
    assert {r[0]: r[1] for r in table.select("doc_id", "text").collect()} == {2: "\n".join(lines), 9: "nobody has seen this line before today"}


def test_rows_without_id_take_nothing_from_others(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    line = "a line of some words that two rows hold"
    given = [(None, passage, "en", "s", len(passage)), (2, passage, "en", "s", len(passage)), (None, f"{line}\n{line}", "en", "s", 79), (3, line, "en", "s", len(line))]
    docs = spark.createDataFrame(given, SCHEMA)
    assert rows(pipeline.substring_dedup(spark, docs, SF)) == Counter(given)
    assert rows(pipeline.line_dedup(spark, docs, SF)) == Counter(given)
