"""Substring dedup: repeated passages found by difference-cover anchors.

A passage of ``WINDOW`` words that two texts share also shares an *anchor*: hashing only
windows of ``ANCHOR`` words at places that lie in ``COVER`` modulo ``PERIOD`` suffices,
because differences of the cover reach every shift of one text against the other. So a
shared window has an anchor at the same distance from its start in both texts.

Anchors that only one text has end there. For the others the *context* decides: the words
that any window around the anchor can reach. Within one context the text with the smallest
object_id has all windows first, so every other text loses them without looking further.
Only where one anchor stands in several contexts, the first text of each context extends
the anchor: it offers the windows around it one by one, compared by a 128-bit hash. All
steps are counts and minima per key and joins; no group is collected and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, result_texts
from .words import as_signed, blocks, mix, powers, stream, window_hashes

WINDOW = 50
# A perfect difference cover: the differences of the six places reach 1..30 once each.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
# A text is told from others of the same object_id by this many bits of its hash.
TAG_BITS, PLACE_BITS = 23, 40


def _anchors(block):
    """Word index, text and place of the anchors of a block, and their hashes."""
    hashes = block.word_hashes()
    text = block.text_of_word()
    places = np.arange(len(hashes)) - block.word_starts[text]
    found = window_hashes(hashes, ANCHOR, seed=0)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    n = len(found)
    enough = (block.word_ends - block.word_starts)[text[:n]] >= WINDOW
    at = np.flatnonzero(covered[places[:n] % PERIOD] & enough & (text[:n] == text[ANCHOR - 1 :][:n]))
    return hashes, text, places, at, found[at]


def _contexts(block, hashes: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of all words that a window around each anchor can reach, and of how far it reaches."""
    base = int(stream(60, 1)[0]) | 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)))])
    back = powers(pow(base, -1, 1 << 64), len(hashes) + 1)
    low = np.maximum(at - (PERIOD - 1), block.word_starts[text[at]])
    high = np.minimum(at + WINDOW, block.word_ends[text[at]])
    reach = ((at - low) * 64 + (high - at)).astype(np.uint64)
    return mix((sums[high] - sums[low]) * back[low] ^ mix(reach))


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor hash once per text."""
    for batch in batches:
        for block in blocks(batch.column("result_text").to_pylist()):
            _, text, _, at, found = _anchors(block)
            if not len(at):
                continue
            order = np.lexsort((found, text[at]))
            key, owner = found[order], text[at][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key[new]))], ["anchor"])


def _anchor_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags = batch.column("tag").to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("result_text").to_pylist()):
            hashes, text, places, at, found = _anchors(block)
            rows = block.first + text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(found)), pa.array(as_signed(_contexts(block, hashes, text, at))),
                 batch.column("object_id").take(pa.array(rows)), pa.array((tags[rows] << PLACE_BITS) | places[at])],
                ["anchor", "context", "object_id", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows around the given anchor places of each text."""
    for batch in batches:
        tags = batch.column("tag").to_numpy(zero_copy_only=False)
        given = batch.column("anchors").to_pylist()
        for block in blocks(batch.column("result_text").to_pylist()):
            hashes = block.word_hashes()
            text = block.text_of_word()
            wanted = np.zeros(len(hashes) + 1, np.int32)
            for k in range(block.size):
                start, end = block.word_starts[k], block.word_ends[k]
                if end - start < WINDOW:
                    continue
                at = np.asarray(given[block.first + k], np.int64)
                np.add.at(wanted, start + np.maximum(at - (PERIOD - 1), 0), 1)
                np.add.at(wanted, start + np.minimum(at, end - start - WINDOW) + 1, -1)
            at = np.flatnonzero(np.cumsum(wanted)[: len(hashes)] > 0)
            if not len(at):
                continue
            rows = block.first + text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(window_hashes(hashes, WINDOW, seed=1)[at])), pa.array(as_signed(window_hashes(hashes, WINDOW, seed=2)[at])),
                 batch.column("object_id").take(pa.array(rows)), pa.array((tags[rows] << PLACE_BITS) | (at - block.word_starts[text[at]]))],
                ["window_a", "window_b", "object_id", "place"])


def _keeper(as_is: bool):
    """Texts without the words of their spans (first window start, last window start)."""

    def kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("result_text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = 0
                if spans:
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, [s["first"] for s in spans], 1)
                    np.add.at(change, [min(s["last"], len(words) - WINDOW) + WINDOW for s in spans], -1)
                    removed = np.cumsum(change)[:-1] > 0
                    gone = int(removed.sum())
                    words = [words[i] for i in np.flatnonzero(~removed)]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(text if as_is and not gone else b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("object_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["object_id", "n_words", "n_removed", "kept_text"])

    return kept_texts


def remove_repeated_passages(results: DataFrame, as_is: bool = False) -> DataFrame:
    """Remove passages of 50 words or more that a text of a smaller object_id has too.

    Reads ``object_id, result_text`` of semantic results. A word goes if some window of 50
    consecutive words covers it whose word sequence also starts in a text with a smaller
    object_id; windows are judged on the input. Returns per input row: object_id, n_words,
    n_removed, ``kept_text`` (remaining words joined by one space; ``as_is``: a text that
    loses nothing is its own kept text, white space and null included).

    Null and empty texts have no words and, unless ``as_is``, empty kept text. Texts under 50 words are never
    touched. Rows with one object_id do not remove from each other: identical ones get the
    same result, different texts are judged apart. Rows without object_id stand outside
    the order, remove nothing and lose nothing. An empty table gives no rows. Other columns
    are not read.
    """
    scratch = Scratch(results.sparkSession, "passages")
    texts = result_texts(results)
    id_field = T.StructField("object_id", texts.schema["object_id"].dataType)
    long = lambda name: T.StructField(name, T.LongType())
    tag = F.xxhash64("result_text").bitwiseAND((1 << TAG_BITS) - 1)
    texts = texts.withColumn("tag", tag)
    ordered = texts.filter("object_id IS NOT NULL AND result_text IS NOT NULL")

    shared = (
        ordered.select("result_text").mapInArrow(_anchor_keys, T.StructType([long("anchor")]))
        .groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    )
    places = ordered.mapInArrow(_anchor_places, T.StructType([long("anchor"), long("context"), id_field, long("place")]))
    found = scratch.write(places.join(shared, "anchor"), "anchors")

    contexts = found.groupBy("anchor", "context").agg(F.min("object_id").alias("first_id"))
    several = contexts.groupBy("anchor").agg((F.count("*") > 1).alias("several"))
    judged = scratch.write(
        found.join(contexts.join(several, "anchor"), ["anchor", "context"])
        .filter("several OR first_id < object_id")
        .select("object_id", "place", (F.col("first_id") < F.col("object_id")).alias("repeated")), "judged")
    scratch.drop(found)

    tag_of = F.shiftright("place", PLACE_BITS).alias("tag")
    place_of = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    extend = (
        judged.filter("NOT repeated").select("object_id", tag_of, place_of.alias("at"))
        .groupBy("object_id", "tag").agg(F.collect_set("at").alias("anchors"))
    )
    offered = scratch.write(
        ordered.join(extend, ["object_id", "tag"]).select("object_id", "result_text", "tag", "anchors")
        .mapInArrow(_windows, T.StructType([long("window_a"), long("window_b"), id_field, long("place")])), "windows")
    first = offered.groupBy("window_a", "window_b").agg(F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"))
    later = offered.join(first.filter("first_id < last_id"), ["window_a", "window_b"]).filter("first_id < object_id")

    # Around an anchor whose whole context repeats, windows start up to 30 words before it;
    # where they end is cut to the text by the reader.
    start = F.greatest(place_of - (PERIOD - 1), F.lit(0))
    whole = judged.filter("repeated").select("object_id", tag_of, start.alias("first"), place_of.alias("last"))
    single = later.select("object_id", tag_of, place_of.alias("first"), place_of.alias("last"))
    spans = (
        whole.unionByName(single).groupBy("object_id", "tag")
        .agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    )
    spans = scratch.write(spans, "spans")
    scratch.drop(judged, offered)
    marked = texts.join(spans, ["object_id", "tag"], "left").select("object_id", "result_text", "spans")
    return marked.mapInArrow(_keeper(as_is), T.StructType([id_field, long("n_words"), long("n_removed"), T.StructField("kept_text", T.StringType())]))
