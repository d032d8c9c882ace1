"""Phrase collocations: best-first branch and bound over growing phrases.

Words and pairs of words are counted in one pass over the texts. A pair is a branch: the
phrases of three words that grow from it. Counts of prefixes bound them from above: such a
phrase occurs at most as often as its pair, and what follows its first word at least as often
as the phrase itself, so its score is at most the share of the first word's occurrences that the pair
makes up. Per language, the branches of best bound are grown first, down to a *reach*; a
phrase that scores at least the reach is then known, with all that can drop it. Languages in
which that settles too few are grown further, to a lower reach; branches below the final
reach are never grown.

Which branches grow is told to the text pass by two bitmaps of one fixed size; a wrong bit
only counts a phrase in vain. Phrases travel as strings with local counts, never one
row per occurrence; text is read in Arrow batches and cut with array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .words import mix, powers, stream

TOP, LEAST, COVERED_PERCENT = 2000, 10, 50
UNKNOWN = "und"
SCORE_ONE = 1_000_000
# Bits of each bitmap of growing branches; more bits spare more phrases counted in vain.
SLOT_BITS = 22
BLOCK_BYTES = 2 << 20
_WORD, _BLANK, _CUT = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 32]] = _BLANK
_KINDS[[*b".,;:!?", 10, 11, 12, 13]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[9] = 32
_BASES = [int(x) | 1 for x in stream(110, 2)]
_VALUES = [stream(111, 256), stream(112, 256)]


class _Words:
    """The words of consecutive texts: lower-cased bytes, spans, pieces, texts and hashes."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        kinds = _KINDS[raw]
        self.bytes = _LOWER[raw]
        edge = np.flatnonzero(np.diff((kinds != _WORD).view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kinds == _CUT, dtype=np.int32)[self.starts]
        limits = np.cumsum([len(part) + 1 for part in parts])
        self.text = np.searchsorted(limits, self.starts, side="right")
        # Two independent 64-bit hashes: one to sort by, one to tell apart what the first does not.
        self.hashes = []
        for base, values in zip(_BASES, _VALUES):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.bytes] * powers(base, len(raw)))])
            back = powers(pow(base, -1, 1 << 64), len(raw) + 1)
            span = (sums[self.ends] - sums[self.starts]) * back[self.starts]
            self.hashes.append(mix(span + (self.ends - self.starts).astype(np.uint64)))

    def phrases(self, width: int) -> np.ndarray:
        """First words of the phrases of ``width`` words within one piece."""
        n = len(self.starts) - width + 1
        return np.flatnonzero(self.piece[:n] == self.piece[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def phrase_hashes(self, at: np.ndarray, width: int, salt: np.ndarray, which: int) -> np.ndarray:
        """Of the phrases at ``at``, with a salt for each text."""
        out = salt[self.text[at]]
        for k in range(width):
            out = mix(out + self.hashes[which][at + k])
        return out

    def strings(self, at: np.ndarray, width: int) -> pa.Array:
        """The phrases, their words joined by one space."""
        words = (at[:, None] + np.arange(width)).ravel()
        starts, lengths = self.starts[words], self.ends[words] - self.starts[words]
        # What follows a word within a piece is a blank, and every blank is a space by now.
        lengths.reshape(-1, width)[:, :-1] += 1
        before = np.cumsum(lengths) - lengths
        taken = self.bytes[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths.reshape(-1, width).sum(axis=1))]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(taken))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[_Words, list[str], np.ndarray]]:
    """Words, languages and number of each text's language of blocks of texts."""
    languages = batch.column("language").to_pylist()
    texts = batch.column("result_text").cast(pa.binary())
    parts: list[bytes] = []
    size = first = 0
    for row in range(batch.num_rows):
        parts.append(texts[row].as_py() or b"")
        size += len(parts[-1]) + 1
        if size >= BLOCK_BYTES or row + 1 == batch.num_rows:
            known, numbers = np.unique(np.array(languages[first : row + 1], object), return_inverse=True)
            yield _Words(parts), list(known), numbers
            parts, size, first = [], 0, row + 1


def _salts(known: list[str], numbers: np.ndarray) -> np.ndarray:
    """A salt for each text, which depends on its language alone."""
    return mix(np.array([zlib.crc32(name.encode()) for name in known], np.uint64) + np.uint64(1 << 40))[numbers]


def _counted(words: _Words, known: list[str], numbers: np.ndarray, at: np.ndarray, width: int) -> pa.RecordBatch:
    """Each phrase once per language of the block, with its count."""
    salt = _salts(known, numbers)
    key, check = (words.phrase_hashes(at, width, salt, which) for which in (0, 1))
    order = np.argsort(key)
    key, check = key[order], check[order]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    chosen = at[order[first]]
    language = pa.array(known, pa.string()).take(pa.array(numbers[words.text[chosen]]))
    counts = np.diff(np.append(first, len(at)))
    return pa.RecordBatch.from_arrays(
        [language, pa.array(np.full(len(chosen), width, np.int32)), words.strings(chosen, width), pa.array(counts, pa.int64())],
        ["language", "width", "phrase", "n"])


COUNTED = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])


def _count_words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, pairs, and as width 0 the number of words, by language."""
    for batch in batches:
        for words, known, numbers in _blocks(batch):
            if not len(words.starts):
                continue
            all_words = np.bincount(numbers[words.text], minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, pa.string()), pa.array(np.zeros(len(known), np.int32)), pa.array([""] * len(known)), pa.array(all_words, pa.int64())],
                ["language", "width", "phrase", "n"])
            for width in (1, 2):
                yield _counted(words, known, numbers, words.phrases(width), width)


def _slots(words: _Words, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (words.phrase_hashes(at, 2, salt, 0) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _branch_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bitmaps: for each branch the place of its bit, and the bit."""
    for batch in batches:
        as_prefix, as_suffix = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("as_prefix", "as_suffix"))
        done = 0
        for words, known, numbers in _blocks(batch):
            at = words.phrases(2)  # one per row
            slots = _slots(words, at, _salts(known, numbers))
            bits = (np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64)
            rows = done + words.text[at]
            done += len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots >> 6), pa.array(np.where(as_prefix[rows], bits, 0)), pa.array(np.where(as_suffix[rows], bits, 0))],
                ["place", "prefix_bits", "suffix_bits"])


def _bitmaps(branches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which slots hold growing prefixes, and which suffixes; of fixed size."""
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("place", "prefix_bits", "suffix_bits")])
    rows = (
        branches.select("language", F.col("phrase").alias("result_text"), "as_prefix", "as_suffix").mapInArrow(_branch_slots, schema)
        .groupBy("place").agg(F.bit_or("prefix_bits").alias("p"), F.bit_or("suffix_bits").alias("s")).toPandas()
    )
    out = np.zeros((2, 1 << (SLOT_BITS - 6)), np.int64)
    out[:, rows["place"].to_numpy()] = rows["p"].to_numpy(), rows["s"].to_numpy()
    return out[0], out[1]


def _triple_counter(prefixes: np.ndarray, suffixes: np.ndarray):
    def holds(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (bitmap[slots >> 6] >> (slots & 63)) & 1 == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, known, numbers in _blocks(batch):
                at, salt = words.phrases(3), _salts(known, numbers)
                at = at[holds(prefixes, _slots(words, at, salt)) | holds(suffixes, _slots(words, at + 1, salt))]
                if len(at):
                    yield _counted(words, known, numbers, at, 3)

    return count


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("language", "width", "phrase").agg(F.sum("n").alias("n"))


def _score(a: str, l: str, r: str) -> Column:
    """Exact: counts below 10^15, products in decimals of 38 digits."""
    a, l, r = (f"cast({name} as decimal(15,0))" for name in (a, l, r))
    return F.expr(f"({SCORE_ONE}BD * ({a} * {a})) div ({l} * {r})").cast("long")


def _reach(pairs: DataFrame, depth: int) -> DataFrame:
    """Per language the score its first ``depth`` pairs have at least; 0 if it has fewer.

    Scores are whole numbers up to a million, so their counts per language are bounded.
    """
    from pyspark.sql import Window

    counts = pairs.groupBy("language", "score").agg(F.count("*").alias("m"))
    above = F.sum("m").over(Window.partitionBy("language").orderBy(F.desc("score")))
    reach = F.coalesce(F.max(F.when(F.col("above") >= depth, F.col("score"))), F.lit(0))
    return counts.withColumn("above", above).groupBy("language").agg(reach.alias("reach"))


def mine_collocations(results: DataFrame, top: int = TOP, least: int = LEAST, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """The ``top`` phrases of two or three words of each language, by how tightly they hold together.

    Reads ``result_text`` of semantic results and their ``language``. Letters A-Z are
    lower-cased, texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    blanks and tabs. Within a language, a phrase with at least ``least`` occurrences a is cut
    after each of its words but the last: l and r count both parts, the score is
    floor(10^6 a a / (l r)), and the cut of lowest score counts (the first of equal ones). A
    phrase goes if a longer one of at least ``least`` occurrences holds it and has at least
    ``covered_percent`` of its occurrences. Returns language, rank (from 1), phrase (words
    joined by one space), a, l, r, n (all words of the language), score; ordered by score,
    then a, both falling, then phrase in byte order.

    A null language is ``und``, and so counted with rows that say ``und``. Null, empty and
    blank texts have no words. Repeated rows count as often as they occur. Other columns,
    object_id among them, are not read. An empty table gives no rows. Languages with fewer
    phrases return all of them. Counts must stay below 10^15.
    """
    scratch = Scratch(results.sparkSession, "collocations")
    texts = results.select(
        F.coalesce(F.col("language").cast("string"), F.lit(UNKNOWN)).alias("language"), F.col("result_text").cast("string").alias("result_text")
    ).filter("result_text IS NOT NULL")
    grams = scratch.write(_summed(texts.mapInArrow(_count_words_and_pairs, COUNTED)).filter((F.col("n") >= least) | (F.col("width") == 0)), "grams")
    words = grams.filter("width = 1")
    joined = (
        grams.filter("width = 2").select("language", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 1).alias("w1"), F.substring_index("phrase", " ", -1).alias("w2"))
        .join(words.select("language", F.col("phrase").alias("w1"), F.col("n").alias("l")), ["language", "w1"])
        .join(words.select("language", F.col("phrase").alias("w2"), F.col("n").alias("r")), ["language", "w2"])
    )
    pairs = scratch.write(
        joined.select("language", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr(f"({SCORE_ONE} * a) div l").alias("bound")), "pairs")

    triples, found, last, depth = None, [], None, 2 * top
    while True:
        reach = _reach(pairs, depth)
        if last is not None:
            reach = reach.join(last.select("language", F.col("reach").alias("before")), "language")
        else:
            reach = reach.withColumn("before", F.lit(None).cast("long"))
        reach = scratch.write(reach, "reach")
        fresh = lambda value: F.expr(f"{value} >= reach AND (before IS NULL OR {value} < before)")
        branches = pairs.join(reach, "language").select("language", "phrase", fresh("bound").alias("as_prefix"), fresh("score").alias("as_suffix"))
        prefixes, suffixes = _bitmaps(branches.filter("as_prefix OR as_suffix"))
        grown = _summed(texts.join(reach.select("language"), "language", "left_semi").mapInArrow(_triple_counter(prefixes, suffixes), COUNTED) if last is not None
                        else texts.mapInArrow(_triple_counter(prefixes, suffixes), COUNTED))
        ends = lambda n, *columns: pairs.select("language", F.col("phrase").alias(n), *columns)
        grown = (
            grown.filter(F.col("n") >= least)
            .select("language", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("head"), F.substring_index("phrase", " ", -2).alias("tail"))
            .join(ends("head", F.col("l").alias("f1"), F.col("a").alias("f12")), ["language", "head"])
            .join(ends("tail", F.col("a").alias("f23"), F.col("r").alias("f3")), ["language", "tail"])
            .withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
            .select("language", "phrase", "a", "head", "tail", F.expr("if(s1 <= s2, f1, f12)").alias("l"), F.expr("if(s1 <= s2, f23, f3)").alias("r"), F.least("s1", "s2").alias("score"))
        )
        # A phrase grown in two rounds, by its head and by its tail, has equal rows.
        triples = scratch.write(grown if triples is None else triples.unionByName(grown).dropDuplicates(["language", "phrase"]), "triples")
        cover = triples.select("language", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("language", "phrase").agg(F.max("a").alias("longer"))
        columns = ("language", "phrase", "a", "l", "r", "score")
        known = pairs.join(cover, ["language", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {covered_percent} * a").select(*columns)
        settled = scratch.write(
            known.unionByName(triples.select(*columns)).join(reach, "language").filter("score >= reach").select(*columns, "reach"), "settled")
        held = settled.groupBy("language").agg(F.count("*").alias("held"))
        last = scratch.write(reach.join(held, "language", "left").filter(f"reach > 0 AND coalesce(held, 0) < {top}").select("language", "reach"), "open")
        found.append(settled.join(last.select("language"), "language", "left_anti"))
        if last.isEmpty():
            break
        depth *= 4
    from functools import reduce

    from pyspark.sql import Window

    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = grams.filter("width = 0").select("language", F.col("n").alias("n"))
    return ranked.join(totals, "language").select("language", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
