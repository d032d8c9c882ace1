"""Text operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import bpe, languages, lines, near, packing, passages, quality, rules
from keepsake.llm.words import blocks, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "object_id long, result_text string, n_words string, score int"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def invented(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    r = random.Random(seed)
    return ["w" + "".join(chr(97 + int(d)) for d in str(int(vocabulary * r.random() ** 2))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, junk, nulls, blanks and long ones."""
    r = random.Random(5)
    texts = [None, "", "  \n\t ", "one", "one", "a b c d", "A  b\tc d e\n\na b c d e"]
    passage = invented(1, 70)
    for k in range(40):
        base = invented(100 + k, r.choice((30, 60, 120, 400)))
        texts.append(" ".join(base))
        if k % 3 == 0:
            texts.append(" ".join(base))
        if k % 4 == 0:
            for j in range(3):
                near_copy = list(base)
                near_copy[r.randrange(len(base))] = f"edit{j}"
                texts.append(" \n".join([" ".join(near_copy[:20]), " ".join(near_copy[20:])]))
        if k % 5 == 0:
            texts.append(" ".join(invented(300 + k, 40) + passage + invented(400 + k, 30)))
    texts.append(" ".join(invented(9, 20_000)))
    r.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[3], (5, "another text of one id"), (None, " ".join(passage)), (None, None)]


@pytest.fixture(scope="module")
def results(spark, corpus):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in corpus], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_hashes_tell_words_and_windows_apart():
    texts = ["a b c", None, "", " a\tb \n c ", "ab c", "ü a b c"]
    (block,) = blocks(texts)
    hashes = block.word_hashes()
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert len(hashes) == len(words)
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    assert window_hashes(hashes, 3)[0] == window_hashes(hashes[3:], 3)[0] == window_hashes(hashes, 3)[-1]


def test_quality_rules(spark, results, corpus):
    extra = [(900, "a b c d e f g h i j a b c d e k"), (901, "x\nx\n \ny\nx"), (902, "ä#ö $ | < one two three four five six seven")]
    frame = results.unionByName(spark.createDataFrame([(i, t, "", 0) for i, t in extra], SCHEMA))
    got = counted(rules.apply_quality_rules(frame).select("object_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t in corpus + extra:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        held = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(held) - len(set(held)), len(inside), failed))
    assert got == counted(want)
    kept = rules.apply_quality_rules(frame)
    assert kept.filter("base_failed AND kept").isEmpty() and not kept.filter("kept").isEmpty()
    assert rules.apply_quality_rules(empty(spark)).isEmpty()


def test_order_of_rules_does_not_change_verdicts(results, monkeypatch):
    given = counted(rules.apply_quality_rules(results).select("object_id", "kept").collect())
    monkeypatch.setattr(rules, "order_rules", lambda results, rules: list(reversed(rules)))
    assert given == counted(rules.apply_quality_rules(results).select("object_id", "kept").collect())


def test_passages(spark, results, corpus):
    got = collections.Counter((r.object_id, r.n_words, r.n_removed, r.kept_text) for r in passages.remove_repeated_passages(results).collect())
    first = {}
    for i, t in corpus:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    want = collections.Counter()
    for i, t in corpus:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 49 if i is not None else 0) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    assert got == want and any(k[2] for k in want)
    assert passages.remove_repeated_passages(empty(spark)).isEmpty()


def test_cover_reaches_every_shift():
    shifts = {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER}
    assert shifts == set(range(passages.PERIOD))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_lines(spark, results, corpus):
    """Against all pairs of lines."""
    order = sorted({(i, t) for i, t in corpus if i is not None and t is not None}, key=lambda x: x[0])
    assert len({i for i, _ in order}) == len(order) - 1  # one id has two texts, whose lines are all new
    placed = [(i, t, k, frozenset(WORD.findall(line))) for i, t in order for k, line in enumerate(t.split("\n"))]
    gone = set()
    for n, (i, t, k, words) in enumerate(placed):
        if words and any(jaccard(words, other) >= 0.8 - 1e-12 for _, _, _, other in placed[:n] if len(other) * 0.8 <= len(words) + 1e-9):
            gone.add((i, t, k))
    want = collections.Counter()
    for i, t in corpus:
        parts = (t or "").split("\n")
        kept = [x for k, x in enumerate(parts) if (i, t, k) not in gone]
        want[i, len(parts), len(parts) - len(kept), None if t is None else "\n".join(kept)] += 1
    got = counted(lines.remove_similar_lines(results).select("object_id", "n_lines", "n_removed", "kept_text").collect())
    assert got == want and gone
    assert lines.remove_similar_lines(empty(spark)).isEmpty()


def plan_of(spark, results, monkeypatch, name):
    """The table that line dedup writes under this name."""
    kept = {}

    class Kept(lines.Scratch):
        def write(self, df, label, options=None):
            table = super().write(df, label, options)
            kept[label] = table
            return table

        def drop(self, *tables):
            pass

    monkeypatch.setattr(lines, "Scratch", Kept)
    lines.remove_similar_lines(results).collect()
    return kept[name]


def test_words_of_lines_are_cut_once_and_kept_as_numbers(spark, results, corpus, monkeypatch):
    """Ranks, sketches and full sets are read from the sets written, not cut from the texts again."""
    sets = plan_of(spark, results, monkeypatch, "sets")
    texts = {(i, t) for i, t in corpus if i is not None and t is not None}
    want = collections.Counter(len(set(WORD.findall(x))) for _, t in texts for x in t.split("\n"))
    assert collections.Counter(r.n for r in sets.select("n").collect()) == want
    assert sets.filter("n <> size(tokens)").isEmpty() and sets.select("id").distinct().count() == sets.count()


def test_pairs_of_lines_grow_no_faster_than_a_group_of_near_copies(spark, monkeypatch):
    base = invented(77, 60)
    near = lambda k: " ".join(base[: k % 60] + [f"edit{k}"] + base[k % 60 + 1 :])
    copies = [(k, near(k), "", 0) for k in range(200)]
    pairs = plan_of(spark, spark.createDataFrame(copies, SCHEMA), monkeypatch, "pairs")
    assert pairs.count() < 10 * len(copies)


def test_few_rows_beside_the_wanted_ones_are_left_by_the_bitmap(spark):
    from keepsake.llm.common import likely_among

    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("text_key"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "text_key string, id long"))
    wanted = rows.filter("id % 7 = 0")
    left = {r["id"] for r in likely_among(rows, wanted, "text_key").collect()}
    held = set(range(0, 20_000, 7))
    assert held <= left and len(left) < len(held) + 200
    assert likely_among(rows, wanted.limit(0), "text_key").isEmpty()


def test_near_duplicates(spark, results, corpus):
    grams = []
    for _, t in corpus:
        w = WORD.findall(t or "")
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [[k for k in range(len(corpus)) if k != n and grams[n] and jaccard(grams[n], grams[k]) >= 0.8] for n in range(len(corpus))]
    want = collections.Counter()
    for n, (i, _) in enumerate(corpus):
        seen, todo = {n}, [n]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [corpus[k][0] for k in seen if corpus[k][0] is not None]
        want[i, min(ids) if ids and grams[n] else i, len(links[n])] += 1
    assert counted(near.near_duplicates(results).select("object_id", "class_id", "n_links").collect()) == want
    assert near.near_duplicates(empty(spark)).isEmpty()


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_TEXTS", 7)
    base = invented(77, 150)
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]), "", 0) for k in range(60)]
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for _, t, _, _ in rows]
    assert {r.class_id for r in got} == {0}
    assert {r.object_id: r.n_links for r in got} == {k: sum(jaccard(s, x) >= 0.8 for x in sets) - 1 for k, s in enumerate(sets)}


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.995), (0.5, 0.9), (0.95, 0.99)])
def test_banding_reaches_its_recall(threshold, recall):
    bands, rows = near.banding(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall


def test_packing(spark, results, corpus):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = packing.pack_results(results, BYTES).collect()
    got, offsets = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.token_ids) == 4 * r.length
        got[r.object_id].append((r.piece, r.start, bytes(r.token_ids)))
        offsets[r.sequence_id].append((r.offset, r.length))
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, at in enumerate(starts):
            piece = ids[at : first if k == 0 else at + 1024]
            got[i].remove((k, at, np.array(piece, "<u4").tobytes()))
    assert not any(got.values())
    for parts in offsets.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_results(empty(spark), BYTES).isEmpty()


def test_open_bins_are_bounded_and_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 2)
    for n in (6, 7, 8):  # the fullest, with 2 left, closes
        bins.place(n)
    assert bins.count == 2 and bins.place(2) == (1, 7)


def odd_texts():
    r = random.Random(3)
    alphabet = [chr(c) for c in range(0x250)] + [" ", "\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "é", "한", "字", "😀", "ﬁ", "１"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(1500)]


def test_encoders_equal_the_library():
    byte, word = tokenizers.Tokenizer.from_file(BYTES), tokenizers.Tokenizer.from_file(WORDS)
    own_byte, own_word = packing.byte_level_encoder(BYTES), bpe.BoundaryEncoder(WORDS)
    for text in odd_texts():
        assert list(own_byte(text)) == byte.encode(text, add_special_tokens=False).ids
        ids = word.encode(text, add_special_tokens=False).ids
        assert own_word.encode(text) == ids
        assert own_word.decode(ids) == word.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(spark, results, corpus):
    word = tokenizers.Tokenizer.from_file(WORDS)
    got = collections.Counter((r.object_id, r.n_tokens, bytes(r.token_ids), r.decoded) for r in bpe.encode_results(results, WORDS).collect())
    want = collections.Counter()
    for i, t in corpus:
        ids = word.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), word.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_results(empty(spark), WORDS).isEmpty()


def test_languages(spark):
    greek, latin, other = "λόγος και άνθρωπος", "the house and the garden", "das haus und der garten"
    known = [(k, t, n) for k in range(30) for n, t in (("el", greek), ("en", latin), ("de", other))] + [(1, None, "en"), (2, latin, None)]
    model = languages.learn_languages(spark.createDataFrame(known, "object_id long, result_text string, language string"))
    assert model.languages == ("de", "el", "en")
    long = " ".join([latin] * 5000)
    rows = [(1, latin.upper()), (2, other), (3, greek), (4, None), (5, "12 ... !"), (6, ""), (7, f"{latin} {latin} {greek}"), (None, other), (2, other), (8, long)]
    frame = spark.createDataFrame([(i, t, "de", 9) for i, t in rows], "object_id long, result_text string, language string, confidence int")
    out = languages.identify_languages(frame, model).collect()
    got = collections.Counter((r.object_id, r.language) for r in out)
    assert got == collections.Counter([(1, "en"), (2, "de"), (3, "el"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (None, "de"), (2, "de"), (8, "en")])
    assert all(0 <= r.confidence <= 1 for r in out)
    mixed = next(r for r in out if r.object_id == 7)
    text = rows[6][1]
    assert [(s.language, text[s.start : s.end]) for s in mixed.spans] == [("en", f"{latin} {latin}"), ("el", greek)]
    nothing = languages.learn_languages(frame.filter("false"))
    assert {r.language for r in languages.identify_languages(frame, nothing).collect()} == {"und"}
    assert languages.identify_languages(frame.filter("false"), model).isEmpty()


def test_viterbi_equals_a_search_of_all_paths():
    r = np.random.default_rng(1)
    from itertools import product

    sizes = [5, 0, 1, 6]
    text = np.repeat(np.arange(4), sizes)
    scores = r.normal(0, 3, (len(text), 3)).astype(np.float32)
    labels = languages._viterbi(scores, text, 4, 2.0)
    for k, n in enumerate(sizes):
        own = scores[text == k]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((value(p) for p in product(range(3), repeat=n)), default=0)
        assert math.isclose(value(labels[text == k].tolist()), best, abs_tol=1e-4)


def test_quality_classifier(spark):
    good = [" ".join(invented(k, 80)).capitalize() + "." for k in range(300)]
    bad = [" ".join(["SPAM!!"] * 40 + invented(k, 5)) for k in range(100)]
    rows = [(k, t, k < 200) for k, t in enumerate(good)] + [(1000 + k, t, None) for k, t in enumerate(bad)]
    known = spark.createDataFrame(rows, "object_id long, result_text string, trusted boolean")
    trusted = known.filter("trusted").select("object_id")
    model = quality.learn_quality(known, trusted)
    assert 0.6 < model.prior < 0.9
    frame = known.unionByName(spark.createDataFrame([(5000, None, None), (5001, "", None), (None, "a", None)], known.schema))
    out = {r.object_id: r.confidence for r in quality.score_quality(frame, model).collect()}
    assert len(out) == 403 and all(0 <= c <= 1 for c in out.values())
    assert sum(out[200 + k] >= 0.3 for k in range(100)) >= 95 and sum(out[1000 + k] >= 0.3 for k in range(100)) <= 5
    assert quality.learn_quality(known.filter("false"), trusted) is None and quality.learn_quality(known, trusted.limit(0)) is None
    assert {r.confidence for r in quality.score_quality(frame, None).collect()} == {0.5}
    assert quality.score_quality(known.filter("false"), model).isEmpty()


def test_packed_ids_are_stable_digests():
    encode = packing.byte_level_encoder(BYTES)
    assert hashlib.sha256(encode("plain text").astype("<u4").tobytes()).hexdigest() == hashlib.sha256(
        np.array(tokenizers.Tokenizer.from_file(BYTES).encode("plain text").ids, "<u4").tobytes()).hexdigest()
