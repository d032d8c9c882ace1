"""Language of texts, word by word, with spans for mixed texts.

Three steps per text. The *script* of a word narrows the languages it may be in. Each
word gets a score per remaining language: the log-likelihood of its letter trigrams. A
Viterbi pass over the words, with a penalty for changing the language, labels spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import result_texts
from .words import mix

UNKNOWN = "und"
# Rows a model is learned from, at most about, and rows of each language at least, if it has
# them; both are parameters of ``learn_languages``.
TRAIN_ROWS, LANGUAGE_ROWS = 20_000, 500
BUCKETS = 1 << 16
# Nats a change of language costs: about three words of evidence.
SWITCH = 12.0
# A language may be written in a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
CHUNK_CHARS = 1 << 19
# Numbers of languages within texts.
LABEL = np.int32

# First and last code point of the scripts told apart (block borders of Unicode).
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF)), "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),), "armenian": ((0x0530, 0x058F),), "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)), "devanagari": ((0x0900, 0x097F),), "bengali": ((0x0980, 0x09FF),),
    "tamil": ((0x0B80, 0x0BFF),), "thai": ((0x0E00, 0x0E7F),), "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


@dataclass(frozen=True)
class LanguageModel:
    """``scores[bucket, language]`` and ``allowed[script, language]``; the last script is all others."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray


def _letter_table() -> np.ndarray:
    """1 for letters, by code point."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


def _script_table() -> np.ndarray:
    table = np.full(0x110000, len(SCRIPTS), np.int8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            table[first : last + 1] = number
    return table


def _chunks(texts: list[str | None], languages: int = 1) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters; fewer for more than 16 languages."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size * max(languages, 16) >= CHUNK_CHARS * 16:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Letters:
    """Words (runs of letters) of several texts: trigram buckets per letter, spans, scripts."""

    def __init__(self, texts: list[str | None], letter: np.ndarray, script: np.ndarray):
        # Lower case may change a length; such rare letters keep their case.
        low = [self._lower(text or "") for text in texts]
        sizes = np.array([len(text) + 1 for text in low])
        codes = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[codes]
        edge = np.flatnonzero(np.diff(is_letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.limits = np.cumsum(sizes)
        self.word_text = np.searchsorted(self.limits, self.starts, side="right")
        self.word_at = self.starts - (self.limits - sizes)[self.word_text]
        self.at = np.flatnonzero(is_letter)
        padded = np.concatenate([[0], np.where(is_letter, codes, 0), [0]]).astype(np.uint64)
        packed = (padded[self.at] << np.uint64(42)) | (padded[self.at + 1] << np.uint64(21)) | padded[self.at + 2]
        self.bucket = (mix(packed) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.lengths = self.ends - self.starts
        self.first_letter = np.cumsum(self.lengths) - self.lengths
        self.script = script[codes[self.starts]] if len(self.starts) else np.zeros(0, np.int8)

    @staticmethod
    def _lower(text: str) -> str:
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def learn_languages(results: DataFrame, max_rows: int = TRAIN_ROWS, language_rows: int = LANGUAGE_ROWS) -> LanguageModel:
    """Trigram and script statistics of every language in ``object_id, result_text, language``.

    Rows without text or language teach nothing. Of more than ``max_rows`` rows a random
    share of about that many is taken, but of each language about ``language_rows`` at least,
    or all it has; so a rare language is learned at any size. What reaches the driver is one
    count per language, and one per language and bucket, whatever the number of rows.
    """
    rows = results.select(F.col("result_text").cast("string").alias("result_text"), F.col("language").cast("string").alias("language"))
    rows = rows.filter("result_text IS NOT NULL AND language IS NOT NULL")
    sizes = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    share = max_rows / max(sum(sizes.values()), 1)
    if share < 1:
        rows = rows.sampleBy("language", {name: min(1.0, max(share, language_rows / n)) for name, n in sizes.items()}, seed=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, script = _letter_table(), _script_table()
        kinds = len(SCRIPTS) + 1
        for batch in batches:
            texts = batch.column("result_text").to_pylist()
            languages = np.array(batch.column("language").to_pylist(), object)
            for language in sorted(set(languages)):
                own = [texts[i] for i in np.flatnonzero(languages == language)]
                found = np.zeros(BUCKETS + kinds, np.int64)
                for a, b in _chunks(own):
                    part = Letters(own[a:b], letter, script)
                    found[:BUCKETS] += np.bincount(part.bucket, minlength=BUCKETS)
                    found[BUCKETS:] += np.bincount(part.script, weights=part.lengths, minlength=kinds).astype(np.int64)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], ["language", "slot", "n"])

    counted = rows.mapInArrow(count, "language string, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counted["language"].unique()))
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    counts[counted["slot"], np.searchsorted(languages, counted["language"])] = counted["n"]
    grams, scripts = counts[:BUCKETS] + 0.05, counts[BUCKETS:]
    scores = np.log(grams / grams.sum(axis=0, keepdims=True))
    allowed = scripts > SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True)
    return LanguageModel(languages, scores.astype(np.float32), allowed)


def _viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """Best language of each word; all texts take their next word together, long ones last on."""
    n_words = np.bincount(text, minlength=n_texts)
    starts = np.cumsum(n_words) - n_words
    order = np.argsort(-n_words, kind="stable")
    sorted_counts = n_words[order]
    labels = scores.argmax(axis=1).astype(LABEL)
    # Where every word says the same, nothing can be better.
    steps = int(sorted_counts[0]) if n_texts else 0
    if not steps or scores.shape[1] < 2:
        return labels
    active = np.searchsorted(-sorted_counts, -np.arange(1, steps + 1), side="right")
    base = starts[order]
    best = scores[base[: active[0]]].copy()
    origin = np.empty(scores.shape, LABEL)
    keep = np.arange(scores.shape[1], dtype=LABEL)
    for t in range(1, steps):
        k = active[t]
        state = best[:k]
        top = state.argmax(axis=1)
        changed = state[np.arange(k), top] - penalty
        moved = changed[:, None] > state
        at = base[:k] + t
        origin[at] = np.where(moved, top[:, None].astype(LABEL), keep)
        best[:k] = np.where(moved, changed[:, None], state) + scores[at]
    last = best.argmax(axis=1).astype(LABEL)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        labels[at] = last[:k]
        if t:
            last[:k] = origin[at, last[:k]]
    return labels


def identify_languages(results: DataFrame, model: LanguageModel, penalty: float = SWITCH) -> DataFrame:
    """Language of the text of every semantic result, and of its spans.

    Reads ``object_id, result_text``. Returns per input row: object_id, ``language`` (the one
    most letters are labelled with; the first by name of equal ones), ``confidence`` (its
    share of the letters, 0 to 1) and ``spans`` (array of ``start, end, language`` in
    characters, runs of words of one language in order). One pass, no shuffle; the model has
    a fixed size per language.

    Null texts and texts without letters are ``und`` with confidence 0 and no spans, as is
    everything for a model that learned no language. Repeated rows are labelled each for
    itself, a null object_id is carried through, an empty table gives no rows, other columns
    are not read.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, script = _letter_table(), _script_table()
        count = len(model.languages)
        # A script no language is written in narrows nothing.
        barred = np.where(model.allowed | ~model.allowed.any(axis=1, keepdims=True), 0, -1e6).astype(np.float32)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, count):
                part, n = Letters(texts[a:b], letter, script), b - a
                best, share = np.full(n, count), np.zeros(n)
                span_text = span_start = span_end = span_label = np.zeros(0, np.int64)
                if count and len(part.starts):
                    scores = np.add.reduceat(model.scores[part.bucket], part.first_letter, axis=0) + barred[part.script]
                    labels = _viterbi(scores, part.word_text, n, penalty)
                    letters = np.bincount(part.word_text * count + labels, weights=part.lengths, minlength=n * count).reshape(n, count)
                    total = letters.sum(axis=1)
                    seen = total > 0
                    best[seen] = letters[seen].argmax(axis=1)
                    share[seen] = letters[seen].max(axis=1) / total[seen]
                    new = np.ones(len(labels), bool)
                    new[1:] = (labels[1:] != labels[:-1]) | (part.word_text[1:] != part.word_text[:-1])
                    first = np.flatnonzero(new)
                    final = np.append(first[1:], len(labels)) - 1
                    span_text, span_label, span_start = part.word_text[first], labels[first], part.word_at[first]
                    span_end = part.word_at[final] + part.lengths[final]
                offsets = np.searchsorted(span_text, np.arange(n + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(span_start, pa.int32()), pa.array(span_end, pa.int32()), pa.array(names[span_label.astype(np.int64)], pa.string())],
                    ["start", "end", "language"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(names[best], pa.string()), pa.array(share),
                     pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    ["object_id", "language", "confidence", "spans"])

    texts = result_texts(results)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType())])
    return texts.mapInArrow(label, T.StructType([
        texts.schema["object_id"], T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("spans", T.ArrayType(span))]))
