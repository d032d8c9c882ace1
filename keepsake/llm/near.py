"""N-gram Jaccard join: near-duplicate texts by MinHash banding and full verification.

A text stands for all its exact copies, so no work is done per copy. Band hashes find
candidates: a band says that two texts probably belong together, and only the link of each
text to one text of the band is kept, so a band of any size costs as many rows as it has
texts. Texts that hang together by such links are then compared on their full n-gram
sets, in blocks of bounded size; a large group is many block pairs, spread over tasks.
A block pair sends on one row per text (its number of links, and one link that keeps it
connected), never a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, likely_among, result_texts
from .components import connected
from .words import Block, as_signed, blocks, mix, stream, window_hashes

WIDTH = 5
THRESHOLD = 0.8
# Share of pairs at exactly the threshold that some band must catch.
RECALL = 0.995
MAX_HASHES = 128
# Bounds of a block of texts compared in one task.
BLOCK_TEXTS, BLOCK_GRAMS = 128, 2_000_000


def banding(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most selective rows whose bands reach the recall."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _grams(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes in text order, and the text of each. A shorter text is one n-gram."""
    hashes = block.word_hashes()
    text = block.text_of_word()
    grams = window_hashes(hashes, width)
    inside = text[: len(grams)] == text[width - 1 :][: len(grams)]
    found, owner = grams[inside], text[: len(grams)][inside]
    sizes = block.word_ends - block.word_starts
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = np.array([window_hashes(hashes[block.word_starts[k] : block.word_ends[k]], int(sizes[k]))[0] for k in short], np.uint64)
        found, owner = np.concatenate([found, mix(whole)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner


def _signer(bands: int, rows: int, width: int):
    flips, factors = stream(70, bands * rows), stream(71, bands * rows) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("result_text").to_pylist()):
                found, owner = _grams(block, width)
                counts = np.bincount(owner, minlength=block.size)
                filled = np.flatnonzero(counts)
                keys = np.zeros((len(filled), bands), np.uint64)
                if len(filled):
                    starts = (np.cumsum(counts) - counts)[filled]
                    for band in range(bands):
                        key = np.full(len(filled), band, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            key = mix(key ^ np.minimum.reduceat((found ^ flips[k]) * factors[k], starts))
                        keys[:, band] = key
                offsets = np.concatenate([[0], np.cumsum((counts > 0) * bands)]).astype(np.int32)
                rows_of = batch.slice(block.first, block.size)
                yield pa.RecordBatch.from_arrays(
                    [rows_of.column("object_id"), rows_of.column("text_key"), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_signed(keys.ravel())))],
                    ["object_id", "text_key", "n_grams", "bands"])

    return sign


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct sets, as products of 0/1 matrices."""
    sets = left + right
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # What one set holds alone is shared by none.
    often = np.bincount(number, minlength=len(values)) > 1
    slot = np.cumsum(often) - 1
    keep = often[number]
    owner, column = owner[keep], slot[number[keep]]
    total, out = int(often.sum()), np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, total, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(sets), min(4096, total - start)), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of ``n`` by an ``n × n`` link matrix."""
    root = np.arange(n)
    while True:
        least = np.where(pairs, root[None, :], n).min(axis=1, initial=n)
        following = np.minimum(root, least)
        following = following[following]
        if (following == root).all():
            return root
        root = following


def _verifier(threshold: float, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("component", "x", "y", "side", "text_key", "copies", "result_text")
        for batch in batches:
            yield from zip(*[batch.column(name).to_pylist() for name in names])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), group in groupby(rows(batches), key=lambda r: r[:3]):
            texts = {(side, key): (copies, text) for _, _, _, side, key, copies, text in group}
            members = sorted(texts)
            sets = []
            for block in blocks([texts[m][1] for m in members]):
                found, owner = _grams(block, width)
                sets += [np.unique(part) for part in np.split(found, np.searchsorted(owner, np.arange(1, block.size)))]
            sizes, copies = np.array([len(s) for s in sets], float), np.array([texts[m][0] for m in members], np.int64)
            cut = len(members) if x == y else sum(side == 0 for side, _ in members)
            a, b = np.arange(cut), np.arange(len(members)) if x == y else np.arange(cut, len(members))
            if not len(a) or not len(b):
                continue
            common = shared_counts([sets[i] for i in a], [sets[i] for i in b])
            union = sizes[a][:, None] + sizes[b][None, :] - common
            links = common >= threshold * union - 1e-6
            if x == y:
                np.fill_diagonal(links, False)
            whole = np.zeros((len(members), len(members)), bool)
            whole[np.ix_(a, b)] = links
            whole |= whole.T
            degree = whole @ copies
            root = local_roots(len(members), whole)
            at = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays(
                [pa.array([members[i][1] for i in at], pa.string()), pa.array(degree[at], pa.int64()), pa.array([members[root[i]][1] for i in at], pa.string())],
                ["text_key", "links", "root"])

    return verify


def near_duplicates(results: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """Groups of semantic results whose texts are near-duplicates.

    Reads ``object_id, result_text``. Two texts are linked if the Jaccard similarity of
    their sets of ``width``-word n-grams is at least ``threshold``; a text of fewer words is one
    n-gram. Returns one row per input row: object_id, ``class_id`` (smallest object_id that
    links reach) and ``n_links`` (other rows linked directly, copies included).

    Pairs are found with probability ``recall`` at the threshold and more above it; every
    link is verified. Null, empty and blank texts are linked with nothing and are a class
    of their own. Rows with equal texts are linked, also under one object_id. A null
    object_id is carried through and never names a class, unless its class has no other.
    An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(results.sparkSession, "near")
    bands, rows = banding(threshold, recall)
    texts = result_texts(results).withColumn("text_key", F.md5(F.coalesce("result_text", F.lit(""))))
    id_field = T.StructField("object_id", texts.schema["object_id"].dataType)
    signed = scratch.write(texts.mapInArrow(_signer(bands, rows, width), T.StructType([
        id_field, T.StructField("text_key", T.StringType()), T.StructField("n_grams", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])), "signatures")
    # Copies meet as (key, count, least id); bands are read again for one of them.
    classes = scratch.write(
        signed.filter("n_grams > 0").groupBy("text_key")
        .agg(F.count("*").alias("copies"), F.min("object_id").alias("first_id"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("text_key", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("text_key").alias("hub"), F.max("text_key").alias("last")).filter("hub < last")
    candidates = banded.join(hubs, "bucket").filter("text_key <> hub").select(F.col("text_key").alias("a"), F.col("hub").alias("b"))
    grouped = scratch.write(
        connected(scratch, candidates).join(classes.select(F.col("text_key").alias("node"), "copies", "first_id", "n_grams"), "node"), "grouped")
    totals = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    placed = grouped.join(totals.select("component", parts.alias("parts")), "component").select(
        F.col("node").alias("text_key"), "component", "copies", "first_id", "parts",
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"))

    # Most texts are like no other; they are left out before the rest is shuffled.
    with_text = likely_among(texts, placed, "text_key").join(placed, "text_key").filter("object_id <=> first_id")
    paired = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "text_key", "copies", "result_text")
    verified = scratch.write(
        paired.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
        .mapInArrow(_verifier(threshold, width), "text_key string, links long, root string"), "verified")

    joined = connected(scratch, verified.select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    linked = joined.join(classes.select(F.col("text_key").alias("node"), "first_id"), "node")
    named = linked.groupBy("component").agg(F.min("first_id").alias("class_id"))
    degrees = verified.groupBy("text_key").agg(F.sum("links").alias("links"))
    judged = scratch.write(
        classes.select("text_key", "copies", "first_id")
        .join(linked.join(named, "component").select(F.col("node").alias("text_key"), "class_id"), "text_key", "left")
        .join(degrees, "text_key", "left")
        .select("text_key", F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "judged")
    scratch.drop(grouped, verified)
    return signed.select("object_id", "text_key").join(judged, "text_key", "left").select(
        "object_id", F.coalesce("class_id", "object_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
