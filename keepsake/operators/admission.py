"""Trailing-window admission, replayed exactly over any amount of history.

A request is admitted when fewer than ``limit`` requests of its principal were
admitted during the ``window`` before it; rejected requests do not count. Every
decision depends on earlier ones, so time lines are replayed in order, as sorted Arrow
batches of which a task holds one at a time. While a principal is saturated the replay
skips, by binary search, to the next stamp at which a request can pass.

A principal with very many requests is cut into chunks of its time line, and ends in
three rounds at most:

1. all chunks are replayed in parallel, after a *warm-up*: the chunk before is replayed first,
   from nothing. What was admitted long ago matters less and less, so the times a chunk starts
   from are usually right after it;
2. each chunk tells the times it started from and ended with. Chunks that started from other
   times than their predecessor ended with are replayed from those, in parallel;
3. principals in which some chunk still starts wrongly (a phase that never fades, as with
   requests at regular intervals) are walked from there on, one after the other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .hotkeys import top_rows

CHUNK_STAMPS = 1_000_000
CELL_MICROS = 10_000_000
# Rows of a replay: times at which requests pass, and per chunk the times it started from and
# ended with, as far as they are still within the window of its first and the next stamp.
PLAYED = "principal string, chunk bigint, stamp bigint, passing bigint, started array<bigint>, ended array<bigint>"


class Replay:
    """The admitted times within the window, fed with sorted runs of stamps."""

    def __init__(self, limit: int, window: int, times: list[int] = ()):
        self.limit, self.window = limit, window
        self.times: deque[int] = deque(list(times)[-limit:] if limit else ())

    def alive(self, stamp: int) -> list[int]:
        """Admitted times that still count at ``stamp``."""
        return [time for time in self.times if time > stamp - self.window]

    def feed(self, stamps: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions in the run at which requests pass, and how many."""
        places, passed = [], []
        at, times, limit, window = 0, self.times, self.limit, self.window
        while at < len(stamps) and limit > 0:
            stamp = int(stamps[at])
            while times and times[0] <= stamp - window:
                times.popleft()
            free = limit - len(times)
            if not free:
                # Nothing passes before the oldest admitted time leaves the window.
                at += max(1, int(np.searchsorted(stamps[at:], times[0] + window)))
                continue
            free = min(free, int(counts[at]))
            times.extend([stamp] * free)
            places.append(at)
            passed.append(free)
            at += 1
        return places, passed


def replay(stamps: list[int], counts: list[int], state: list[int], limit: int, window: int) -> tuple[list[int], list[int]]:
    """How many of the ``counts`` pass at each of the sorted ``stamps``, and the state after."""
    player = Replay(limit, window, state)
    places, passed = player.feed(np.asarray(stamps, np.int64), np.asarray(counts, np.int64))
    out = np.zeros(len(stamps), np.int64)
    out[places] = passed
    return out.tolist(), list(player.times)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, slice]]:
    """Stretches of one principal and chunk, as rows stand."""
    principals, chunks = batch.column("principal"), batch.column("chunk").to_numpy(zero_copy_only=False)
    codes = principals.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(chunks) != 0)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows]):
        if end > start:
            yield (principals[int(start)].as_py(), int(chunks[start])), slice(int(start), int(end))


def _player(limit: int, window: int, walk: bool):
    """Replays rows sorted by principal, chunk, warm-up first, and stamp.

    A chunk starts from the times in ``incoming`` of its first row; if that is null, from
    what its predecessor left (``walk``) or from nothing. Warm-up rows are replayed and not
    told.
    """

    def told(key, places, stamps, passed) -> pa.RecordBatch:
        n = len(places)
        none = pa.nulls(n, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(stamps[places], pa.int64()), pa.array(passed, pa.int64()), none, none],
            ["principal", "chunk", "stamp", "passing", "started", "ended"])

    def closing(key, started, ended) -> pa.RecordBatch:
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
             pa.array([started], lists), pa.array([ended], lists)],
            ["principal", "chunk", "stamp", "passing", "started", "ended"])

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, player, started = None, None, None
        for batch in batches:
            stamps = batch.column("stamp").to_numpy(zero_copy_only=False)
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for run, rows in _runs(batch):
                if run != key:
                    if key is not None:
                        yield closing(key, started or [], list(player.times))
                    incoming = batch.column("incoming")[rows.start].as_py()
                    carried = player.times if walk and key is not None and key[0] == run[0] else ()
                    key, player, started = run, Replay(limit, window, carried if incoming is None else incoming), None
                warm = rows.start + int(np.searchsorted(own[rows], 1))
                player.feed(stamps[rows.start : warm], counts[rows.start : warm])
                if warm < rows.stop:
                    if started is None:
                        started = player.alive(int(stamps[warm]))
                    here = slice(warm, rows.stop)
                    places, passed = player.feed(stamps[here], counts[here])
                    if places:
                        yield told(key, places, stamps[here], passed)
        if key is not None:
            yield closing(key, started or [], list(player.times))

    return play


def _played(rows: DataFrame, limit: int, window: int, walk: bool = False) -> DataFrame:
    key = ["principal"] if walk else ["principal", "chunk"]
    ordered = rows.select("principal", "chunk", "own", "stamp", "n", "incoming").repartition(*key).sortWithinPartitions("principal", "chunk", "own", "stamp")
    return ordered.mapInArrow(_player(limit, window, walk), PLAYED)


def _chunked(stamps: DataFrame, chunk_stamps: int) -> DataFrame:
    """Number the chunks of each principal: runs of whole cells of about ``chunk_stamps`` rows.

    The number of cells follows from the time covered, not from the number of requests.
    """
    cell = F.floor(F.col("stamp") / CELL_MICROS).cast("long")
    celled = stamps.withColumn("cell", cell)
    sizes = celled.groupBy("principal", "cell").agg(F.count("*").alias("n_stamps"))
    before = Window.partitionBy("principal").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.withColumn("chunk", F.floor(F.coalesce(F.sum("n_stamps").over(before), F.lit(0)) / chunk_stamps))
    # Chunks are numbered without gaps, so that the one before is found by its number.
    numbered = numbered.withColumn("chunk", (F.dense_rank().over(Window.partitionBy("principal").orderBy("chunk")) - 1).cast("long"))
    return celled.join(numbered.select("principal", "cell", "chunk"), ["principal", "cell"], "inner").drop("cell")


def _wrong_starts(chunks: DataFrame, window: int) -> DataFrame:
    """Chunks that started from other times than their predecessor ended with, and those."""
    along = Window.partitionBy("principal").orderBy("chunk")
    ended = F.coalesce(F.lag("ended").over(along), F.array().cast("array<bigint>"))
    due = chunks.withColumn("due", ended).withColumn("due", F.filter("due", lambda time: time > F.col("first") - window))
    return due.filter("due <> started").select("principal", "chunk", F.col("due").alias("incoming"))


def _ends(played: DataFrame) -> DataFrame:
    return played.filter("ended IS NOT NULL").select("principal", "chunk", "started", "ended")


def _replaced(played: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of the chunks that were replayed again take the place of the earlier ones."""
    return played.join(_ends(again).select("principal", "chunk"), ["principal", "chunk"], "left_anti").unionByName(again)


def passing_counts(stamps: DataFrame, limit: int, window: int, chunk_stamps: int = CHUNK_STAMPS) -> DataFrame:
    """``principal, stamp, passing`` for ``principal, stamp, n`` (stamps in microseconds).

    Only stamps at which some request passes are returned.
    """
    result = lambda played: played.filter("stamp IS NOT NULL").select("principal", "stamp", "passing")
    whole = lambda rows: _played(rows.select("*", F.lit(0).cast("long").alias("chunk"), F.lit(1).alias("own"), F.lit(None).cast("array<bigint>").alias("incoming")), limit, window)
    hot = materialise(stamps.groupBy("principal").agg(F.count("*").alias("n_stamps")).filter(F.col("n_stamps") > chunk_stamps).select("principal"), "admission-hot")
    if hot.isEmpty():
        return result(whole(stamps))
    cold = result(whole(stamps.join(hot, "principal", "left_anti")))
    work = materialise(_chunked(stamps.join(hot, "principal", "left_semi"), chunk_stamps), "admission-chunks")
    firsts = work.groupBy("principal", "chunk").agg(F.min("stamp").alias("first"))
    chunk = F.col("chunk")
    # Each row serves its own chunk, and the next one as warm-up.
    last = work.groupBy("principal").agg(F.max("chunk").alias("last"))
    serves = F.when(chunk < F.col("last"), F.array(F.struct(chunk.alias("chunk"), F.lit(1).alias("own")), F.struct((chunk + 1).alias("chunk"), F.lit(0).alias("own")))).otherwise(
        F.array(F.struct(chunk.alias("chunk"), F.lit(1).alias("own"))))
    warmed = work.join(last, "principal").select("principal", "stamp", "n", F.explode(serves).alias("s"), F.lit(None).cast("array<bigint>").alias("incoming")).select("*", "s.*")
    played = materialise(_played(warmed, limit, window), "admission-round")
    own = work.withColumn("own", F.lit(1))
    for walk in (False, True):
        wrong = materialise(_wrong_starts(_ends(played).join(firsts, ["principal", "chunk"]), window), "admission-wrong")
        if wrong.isEmpty():
            break
        if walk:
            # From the first wrong chunk on, each chunk starts from what the one before left.
            since = wrong.groupBy("principal").agg(F.min("chunk").alias("since"), F.min_by("incoming", "chunk").alias("start"))
            rows = own.join(since, "principal").filter("chunk >= since").withColumn("incoming", F.when(chunk == F.col("since"), F.col("start")))
        else:
            rows = own.join(wrong, ["principal", "chunk"])
        played = materialise(_replaced(played, _played(rows, limit, window, walk)), "admission-round")
    return cold.unionByName(result(played))


def replay_admission(requests: DataFrame, limit: int, window_seconds: float,
                     chunk_stamps: int = CHUNK_STAMPS) -> DataFrame:
    """Add ``admitted`` to requests (``request_id, principal, stamp`` in microseconds).

    Requests of one principal with equal stamps are taken in order of their ids.
    """
    window = int(window_seconds * 1_000_000)
    requests = requests.withColumn("principal", F.col("principal").cast("string"))
    stamps = requests.groupBy("principal", "stamp").agg(F.count("*").alias("n"))
    passing = passing_counts(stamps, limit, window, chunk_stamps)
    # At most ``limit`` requests pass per stamp, so tasks cut their share before the shuffle.
    first = top_rows(requests.select("request_id", "principal", "stamp"), ["principal", "stamp"],
                     [F.col("request_id")], limit, "nth")
    allowed = first.join(passing, ["principal", "stamp"], "inner").filter("nth <= passing")
    flags = allowed.select("request_id", F.lit(True).alias("_ok"))
    return requests.join(flags, "request_id", "left").withColumn(
        "admitted", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")
