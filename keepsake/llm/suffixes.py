"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion.

Within a group of byte segments, the suffixes are sorted and their Burrows-Wheeler transform
is expanded breadth first: level by level, every interval of suffixes that share a string is
extended backward by each byte before it, which yields the places where neighbouring
suffixes differ after exactly as many bytes as the level has. Common prefixes so appear by
increasing length, and expansion stops at the least length asked for: neighbours not told
apart by then share a string of that length.

Groups come from the texts alone. Every window of the least length is filed under the
smallest hash of the short strings in it, its *anchor*; equal windows have equal anchors.
Runs of neighbouring windows with one anchor are one *segment*. Anchors that only one
segment has, and only once, end there. Equal segments are folded into one with a weight, so that copies cost
one of them. An anchor with very many different segments is dealt to several groups; windows
left alone in their group are then compared across its groups by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, result_texts
from .words import as_signed, mix, powers, stream

LEAST = 200
GRAM = 64
# Texts are read in parts of this many windows; a segment has this many windows at most.
PART_WINDOWS, SEGMENT_WINDOWS = 1 << 20, 4096
# Segments of one anchor beyond this many bytes are dealt to several groups.
GROUP_BYTES = 1 << 19
# Groups are sorted and expanded together up to this many bytes.
BATCH_BYTES = 1 << 20
_BASES = [int(x) | 1 for x in stream(120, 3)]
_VALUES = [stream(121 + k, 256) for k in range(3)]
_PACKED = 7


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any stretch follows, and the factor of each start."""
    base = _BASES[which]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[which][data] * powers(base, len(data)))])
    return sums, powers(pow(base, -1, 1 << 64), len(data) + 1)


def _stretch(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[0][end] - sums[0][start]) * sums[1][start] + (end - start).astype(np.uint64))


def _sliding(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = choose(out[: len(out) - step], out[step:])
        reach += step
    return out


class _Segments:
    """Segments of consecutive parts of texts: part, first window, windows and anchor of each."""

    def __init__(self, parts: list[bytes], least: int):
        self.data = b"".join(parts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        lengths = np.array([len(part) for part in parts])
        self.part_starts = np.cumsum(lengths) - lengths
        self.gram = min(GRAM, least)
        at = np.arange(len(self.data) - self.gram + 1)
        self.grams = _stretch(_sums(self.bytes, 0), at, at + self.gram)
        anchors = _sliding(np.minimum, self.grams, least - self.gram + 1)
        part = np.repeat(np.arange(len(parts)), lengths)[: len(anchors)]
        inside = np.arange(len(anchors)) + least <= (self.part_starts + lengths)[part]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (part[1:] != part[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new & inside)
        limits = np.append(np.flatnonzero(new | ~inside), len(anchors))
        count = limits[np.searchsorted(limits, starts, side="right")] - starts
        # Runs of one anchor may be long (periodic texts): they are cut.
        pieces = -(-count // SEGMENT_WINDOWS)
        number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, count = np.repeat(starts, pieces) + number * SEGMENT_WINDOWS, np.repeat(count, pieces)
        self.count = np.minimum(count - number * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
        self.starts, self.ends = starts, starts + self.count + least - 1
        self.part = part[starts]
        self.anchors = anchors[starts]
        self.window_anchors = np.where(inside, anchors, 0)

    def doubled(self) -> np.ndarray:
        """Segments that hold their anchor string twice, so that two of their windows may be equal."""
        side = np.zeros(len(self.grams) - len(self.window_anchors), np.uint64)
        chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate([side, self.window_anchors, side]), len(side) + 1) == self.grams)
        known, number = np.unique(self.grams[chosen], return_inverse=True)
        places = np.sort(number * len(self.data) + chosen)
        base = np.searchsorted(known, self.anchors) * len(self.data)
        return np.searchsorted(places, base + self.ends - self.gram, side="right") - np.searchsorted(places, base + self.starts) > 1

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("starts", "ends", "count", "part", "anchors"):
            setattr(self, name, getattr(self, name)[chosen])


def _parts(texts: pa.Array, least: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Parts of texts with at least one window, the row and the place of each, in blocks."""
    parts, rows, places, size = [], [], [], 0
    for row in range(len(texts)):
        text = texts[row].as_py()
        for place in range(0, len(text) - least + 1, PART_WINDOWS):
            parts.append(text[place : place + PART_WINDOWS + least - 1])
            rows.append(row)
            places.append(place)
            size += len(parts[-1])
            if size >= PART_WINDOWS:
                yield parts, rows, places
                parts, rows, places, size = [], [], [], 0
    if parts:
        yield parts, rows, places


def _anchor_lister(least: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            for parts, rows, _ in _parts(batch.column("result_text").cast(pa.binary()), least):
                found = _Segments(parts, least)
                times = 1 + found.doubled()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(found.anchors).repeat(times)), pa.array(keys[np.array(rows)[found.part]].repeat(times))], ["anchor", "text_key"])

    return anchors


def _segment_cutter(least: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("anchors")
            allowed = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for parts, rows, places in _parts(batch.column("result_text").cast(pa.binary()), least):
                found = _Segments(parts, least)
                edges = np.searchsorted(found.part, np.arange(len(parts) + 1))
                anchors = as_signed(found.anchors)
                shared = np.zeros(len(anchors), bool)
                for k, row in enumerate(rows):
                    one = slice(edges[k], edges[k + 1])
                    shared[one] = np.isin(anchors[one], allowed[ends[row - 1] if row else 0 : ends[row]])
                found.keep(shared)
                if not len(found.starts):
                    continue
                hashes = [pa.array(as_signed(_stretch(_sums(found.bytes, k), found.starts, found.ends))) for k in (1, 2)]
                place = np.array(places)[found.part] + found.starts - found.part_starts[found.part]
                data = [found.data[s:e] for s, e in zip(found.starts.tolist(), found.ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_hash").take(pa.array(np.array(rows)[found.part])), pa.array(place),
                     pa.array(as_signed(found.anchors)), *hashes, pa.array(data, pa.binary())],
                    ["text_hash", "place", "anchor", "segment_a", "segment_b", "segment"])

    return segments


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order, of strings each closed by a symbol 0 at ``ends``.

    Closing symbols are smaller than all others and among themselves ordered as they stand.
    By doubling: seven symbols first, then only what is still equal, twice as far each time.
    """
    n = len(symbols)
    close = np.repeat(ends, np.diff(ends, prepend=-1))
    left = close - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(_PACKED):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - k] = symbols[k:]
        ahead[left < k] = 0
        key = (key << np.uint64(9)) | ahead
    order = np.argsort(key)
    key = key[order]
    order[: len(ends)] = ends
    new = np.ones(n, bool)
    new[len(ends) + 1 :] = key[len(ends) + 1 :] != key[len(ends) : -1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = np.flatnonzero(~(new & np.append(new[1:], True)))
    reach = _PACKED
    while len(active):
        at = order[active]
        key = (rank[at] << 32) | rank[np.minimum(at + reach, close[at])]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[active] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


def common_prefix_bounds(symbols: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and which differ from the one before within their first ``least`` symbols.

    Interval expansion on the Burrows-Wheeler transform, one level per length of the shared
    string. Of an interval's rows, the last with a byte in front of it gives the end of the
    interval extended by that byte, the first its start. An end that is new at level k
    marks suffixes with a common prefix of k symbols; ends known before need no further look.
    """
    n, m = len(symbols), len(ends)
    order = suffix_order(symbols, ends)
    before = symbols[order - 1]
    before[order == 0] = 0
    by_byte = np.argsort(before, kind="stable")
    to_front = np.empty(n, np.int64)  # row of the suffix one symbol longer
    to_front[by_byte] = np.arange(n)
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    extends = before != 0

    bounds = np.zeros(n + 1, bool)
    bounds[: m + 1] = bounds[n] = True
    first, last = np.zeros(1, np.int64), np.full(1, n - 1)
    for level in range(least):
        sizes = last - first + 1
        rows = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        opens = (previous[rows] < np.repeat(first, sizes)) & extends[rows]
        closes = (following[rows] > np.repeat(last, sizes)) & extends[rows]
        # Intervals of one level are apart, so starts and ends pair up in order.
        first, last = np.sort(to_front[rows[opens]]), np.sort(to_front[rows[closes]])
        fresh = ~bounds[last + 1]
        first, last = first[fresh], last[fresh]
        bounds[last + 1] = True
        if level == 0:  # the closing symbols are intervals of one symbol as well
            first, last = np.append(np.arange(m), first), np.append(np.arange(m), last)
        if not len(first):
            break
    return order, bounds[:n]


def repeated_windows(segments: list[bytes], weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the concatenated, closed segments: positions of windows, class of each, weight of each class."""
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[ends] = 0
    order, bounds = common_prefix_bounds(symbols, ends, least)
    of = np.repeat(np.arange(len(segments)), lengths + 1)
    classes = np.cumsum(bounds) - 1
    weight = np.bincount(classes, weights=weights[of[order]]).astype(np.int64)
    window = ends[of[order]] - order >= least
    return order[window], classes[window], weight


def _ranges(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged positions: segment, first and last offset."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, last = edge[0::2], edge[1::2] - 1
    of = np.searchsorted(starts, first, side="right") - 1
    return of, first - starts[of], last - starts[of]


RANGE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
WINDOW = T.StructType([T.StructField(name, T.LongType()) for name in ("at", "window_a", "window_b", "weight")])


def _lists(of: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.Array:
    """Structs of columns sorted by ``of``, as one list for each of ``n`` rows."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _expand(rows: list[pa.RecordBatch], least: int) -> pa.RecordBatch:
    """Decided windows of whole groups: ranges, and for shared anchors what other groups must know."""
    table = pa.Table.from_batches(rows).combine_chunks()
    segments = table.column("segment").to_pylist()
    weights = table.column("weight").to_numpy()
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    position, classes, weight = repeated_windows(segments, weights, least)
    flags = np.zeros(int(lengths.sum()) + len(segments), bool)
    twice = weight[classes] >= 2
    flags[position[twice]] = True
    of, first, last = _ranges(flags, starts)
    # Where an anchor has several groups: one window of each class, whatever its weight.
    split = table.column("split").to_numpy(zero_copy_only=False)
    owner = np.searchsorted(starts, position, side="right") - 1
    new = np.ones(len(position), bool)
    new[1:] = classes[1:] != classes[:-1]
    told = np.flatnonzero(new & split[owner])
    told = told[np.lexsort((position[told], owner[told]))]
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    at = position[told]
    hashes = [_stretch(_sums(data, k), at, at + least) if len(at) else np.zeros(0, np.uint64) for k in (1, 2)]
    windows = {"at": at - starts[owner[told]], "window_a": as_signed(hashes[0]), "window_b": as_signed(hashes[1]), "weight": weight[classes[told]]}
    return pa.RecordBatch.from_arrays(
        [*(table.column(c).combine_chunks() for c in ("anchor", "segment_a", "segment_b")),
         _lists(of, len(segments), {"first": first, "last": last}), _lists(owner[told], len(segments), windows)],
        ["anchor", "segment_a", "segment_b", "ranges", "windows"])


def _expander(least: int):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups follow each other; some at a time are expanded, none is cut."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            anchor = batch.column("anchor").to_numpy()
            length = np.cumsum(pc.binary_length(batch.column("segment")).to_numpy(zero_copy_only=False))
            start = 0
            for k in np.append(np.flatnonzero((np.diff(group) != 0) | (np.diff(anchor) != 0)) + 1, batch.num_rows):
                part = batch.slice(start, k - start)
                if held and size >= BATCH_BYTES and (anchor[start], group[start]) != tip:
                    yield _expand(held, least)
                    held, size = [], 0
                held.append(part)
                size += int(length[k - 1] - (length[start - 1] if start else 0))
                tip, start = (anchor[k - 1], group[k - 1]), k
        if held:
            yield _expand(held, least)

    return expand


def _cutter(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("result_text").cast(pa.binary())
            out = [[], [], [], [], []]
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                text = texts[row].as_py() or b""
                removed: list[tuple[int, int]] = []
                for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
                    if removed and first <= removed[-1][1]:
                        removed[-1] = (removed[-1][0], max(removed[-1][1], last + least))
                    else:
                        removed.append((first, last + least))
                edges = [0, *(edge for run in removed for edge in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(removed), [{"start": a, "end": b} for a, b in removed], kept)):
                    column.append(value)
            long = lambda values: pa.array(values, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("object_id"), *map(long, out[:3]), pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[4], pa.binary())],
                ["object_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"])

    return cut


def remove_repeated_strings(results: DataFrame, least: int = LEAST) -> DataFrame:
    """Remove every byte that a string of ``least`` bytes covers which also starts anywhere else.

    Reads ``object_id, result_text`` of semantic results, texts as UTF-8 bytes. A string counts
    as repeated if it starts at two places or more, of one row or of several, overlaps
    included; matches never cross rows. Strings are judged on the input, not on what is left,
    so all copies lose it. Returns per input row: object_id, n_bytes, n_removed, n_spans
    (maximal removed runs), ``spans`` (start, end in bytes) and ``kept_bytes``, the remaining
    bytes concatenated (binary: a cut may part the bytes of a character).

    Null and empty texts have no bytes; texts below ``least`` bytes lose nothing. Rows that
    repeat, by text or also by object_id, are places of their own, so copies of a text of
    ``least`` bytes lose all of it. The object_id is never compared and may be null. An empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(results.sparkSession, "suffixes")
    long = lambda *names: [T.StructField(name, T.LongType()) for name in names]
    text = F.coalesce("result_text", F.lit(""))
    texts = result_texts(results).withColumn("text_hash", F.unhex(F.md5(text)))
    keyed = texts.select("text_hash", F.xxhash64("result_text").alias("text_key"), "result_text").filter(F.octet_length("result_text") >= least)

    anchors = scratch.write(keyed.select("text_key", "result_text").mapInArrow(_anchor_lister(least), T.StructType(long("anchor", "text_key"))), "anchors")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # Keys of texts only say where to look; the anchors of different texts under one key do no harm.
    wanted = anchors.join(shared, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    places = T.StructType([T.StructField("text_hash", T.BinaryType()), *long("place", "anchor", "segment_a", "segment_b"), T.StructField("segment", T.BinaryType())])
    found = scratch.write(keyed.join(wanted, "text_key").select("text_hash", "result_text", "anchors").mapInArrow(_segment_cutter(least), places), "segments")
    scratch.drop(anchors)

    key = ["anchor", "segment_a", "segment_b"]
    folded = scratch.write(
        found.groupBy(*key).agg(F.count("*").alias("weight"), F.first("segment").alias("segment")).withColumn("size", F.octet_length("segment").cast("long")), "folded")
    large = folded.groupBy("anchor").agg(F.ceil(F.sum("size") / GROUP_BYTES).alias("groups")).filter("groups > 1")
    grouped = (
        folded.join(large, "anchor", "left")
        .select(*key, "weight", "segment", F.expr("groups IS NOT NULL").alias("split"), F.coalesce(F.pmod("segment_a", "groups"), F.lit(0)).cast("long").alias("group"))
        .repartition("anchor", "group").sortWithinPartitions("anchor", "group")
    )
    outcome = T.StructType([*long(*key), T.StructField("ranges", T.ArrayType(RANGE)), T.StructField("windows", T.ArrayType(WINDOW))])
    decided = scratch.write(grouped.mapInArrow(_expander(least), outcome), "decided")
    scratch.drop(folded)

    told = decided.select(*key, F.explode("windows").alias("w")).select(*key, "w.*")
    again = told.groupBy("anchor", "window_a", "window_b").agg(F.sum("weight").alias("all")).filter("all > 1")
    late = told.filter("weight = 1").join(again, ["anchor", "window_a", "window_b"]).select(*key, F.col("at").alias("first"), F.col("at").alias("last"))
    ranges = decided.select(*key, F.explode("ranges").alias("r")).select(*key, "r.*").unionByName(late)
    spans = scratch.write(
        found.select("text_hash", "place", *key).join(ranges, key)
        .groupBy("text_hash").agg(F.collect_set(F.struct((F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("last")).alias("last"))).alias("spans")), "spans")
    scratch.drop(found, decided)
    marked = texts.join(spans, "text_hash", "left").select("object_id", "result_text", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return marked.mapInArrow(_cutter(least), T.StructType([
        texts.schema["object_id"], *long("n_bytes", "n_removed", "n_spans"), T.StructField("spans", span), T.StructField("kept_bytes", T.BinaryType())]))
