"""Collocations against brute force: languages, ties, covered phrases and several rounds."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keepsake.llm import collocations

SCHEMA = "object_id long, result_text string, language string, phrase string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least, covered):
    counts = [defaultdict(Counter) for _ in range(4)]
    for text, language in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for width in (1, 2, 3):
                counts[width][language or "und"].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for language, single in counts[1].items():
        f = lambda phrase: counts[len(phrase)][language][phrase]
        scored = []
        longer = Counter()
        for phrase, a in counts[3][language].items():
            for part in (phrase[:2], phrase[1:]):
                longer[part] = max(longer[part], a if a >= least else 0)
        for width in (2, 3):
            for phrase, a in counts[width][language].items():
                if a < least or (width == 2 and longer[phrase] and 100 * longer[phrase] >= covered * a):
                    continue
                cuts = [(10**6 * a * a // (f(phrase[:k]) * f(phrase[k:])), k) for k in range(1, width)]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(phrase).encode(), f(phrase[:k]), f(phrase[k:])))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((language, rank, phrase.decode(), -a, l, r, sum(single.values()), -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["The", "the", "of", "Ärger", "ärger", "x\x00y", "-", "new", "york", "city", "a", "a", "日本", "b c"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "fr"), (None, "none")]
    for k in range(300):
        text = "".join(r.choice(words) + r.choice((" ", " ", " ", "\t ", "  ", ", ", ".", "\n", "\r", "! ")) for _ in range(r.randrange(60)))
        rows.append((text, r.choice(("en", "en", "fr", None, "und"))))
    for k in range(60):  # phrases held together to different degrees, many of equal score
        rows.append((" ".join(f"p{k} q{k} s{k}" + (f" t{j}" if j % (k % 5 + 1) else "") for j in range(10 + k % 7)), "de"))
    return rows + rows[:40]


@pytest.mark.parametrize("top, least, covered", [(2000, 10, 50), (5, 3, 50), (3, 2, 100), (1, 1, 1), (40, 10, 50)])
def test_equals_brute_force(spark, rows, top, least, covered):
    frame = spark.createDataFrame([(k, t, g, "clash", "clash") for k, (t, g) in enumerate(rows)], SCHEMA).repartition(4)
    got = collocations.mine_collocations(frame, top, least, covered)
    columns = ("language", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in got.select(*columns).collect()) == brute(rows, top, least, covered)


def test_covered_pairs_open_further_rounds(spark, monkeypatch):
    """The best pairs are all covered by their triples, which score less: the reach must fall."""
    rows = [(". ".join([f"u{k} v{k} common"] * 12 + [f"u{k}"] * (k % 3)), "en") for k in range(30)]
    rows += [(". ".join([f"m{k} n{k}"] * 10 + [f"m{k}", f"n{k}"] * 20), "en") for k in range(9)]
    depths = []
    reach = collocations._reach
    monkeypatch.setattr(collocations, "_reach", lambda pairs, depth: depths.append(depth) or reach(pairs, depth))
    got = collocations.mine_collocations(spark.createDataFrame(rows, "result_text string, language string"), 5, 10, 50)
    columns = ("language", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in got.select(*columns).collect()) == brute(rows, 5, 10, 50)
    assert len(depths) > 1


def test_wrong_bits_only_cost_work(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "SLOT_BITS", 8)
    frame = spark.createDataFrame(rows, "result_text string, language string")
    got = collocations.mine_collocations(frame, 7, 3, 50)
    columns = ("language", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(x) for x in got.select(*columns).collect()) == brute(rows, 7, 3, 50)


def test_large_counts_are_exact(spark):
    big = 999_999_999_989
    (row,) = spark.createDataFrame([(big - 1, big, big + 8)], "a long, l long, r long").select(collocations._score("a", "l", "r")).collect()
    assert row[0] == 10**6 * (big - 1) ** 2 // (big * (big + 8))


def test_empty_table(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).collect() == []


def test_words_of_blocks():
    words = collocations._Words([b"A  b\tc.d", b"", "É x\n".encode()])
    assert words.strings(np.arange(len(words.starts)), 1).to_pylist() == ["a", "b", "c", "d", "É", "x"]
    at = words.phrases(2)
    assert words.strings(at, 2).to_pylist() == ["a b", "b c", "É x"] and words.text[at].tolist() == [0, 0, 2]
