"""Embedding near-duplicates by collision-counting projections.

Unit vectors that are close stay close on every line they are projected to. Many random
lines are used in two ways. *Tables* cut a few projections each into cells, so that
vectors that may be close are dealt to the same bucket. Within a bucket the collisions of a
pair are counted: on how many of the other projections one vector lies in the window
centred on the other. Pairs whose count reaches what close pairs reach with the wanted
recall are verified by their cosine in double precision.

All three numbers (projections per table, tables, count) follow from the recall, the
threshold and the number of vectors; none drops a pair for reasons of size. Large buckets
are split into blocks, and a pair of blocks sends on counts and one link per vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .components import connected
from .near import local_roots
from .words import as_signed, mix

THRESHOLD = 0.95
# Share of pairs at exactly the threshold that shares a bucket, and that passes the count.
TABLE_RECALL, COUNT_RECALL = 0.985, 0.999
COUNTED = 32
# Expected vectors per bucket, for vectors without any structure.
BUCKET_ROWS = 200
BLOCK_ROWS = 128
# Cells and windows in units of 1/sqrt(dimensions), the spread of a projection.
CELL = 2.0


@dataclass(frozen=True)
class Plan:
    """Projections per table, tables, collisions asked for, and the half width of a window."""

    per_table: int
    tables: int
    count: int
    window: float


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _same_cell(spread: float, width: float) -> float:
    """Chance that two values share a cell; their difference is normal with this spread."""
    steps = (np.arange(2000) + 0.5) / 2000 * width
    density = 2 * np.exp(-0.5 * (steps / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
    return float((density * (1 - steps / width)).sum() * width / 2000)


def calibrate(n: int, threshold: float = THRESHOLD) -> Plan:
    distance = math.sqrt(2 - 2 * threshold)
    near, far = _same_cell(distance, CELL), _same_cell(math.sqrt(2), CELL)
    per_table = max(1, math.ceil(math.log(max(n, 2) / BUCKET_ROWS) / -math.log(far)))
    tables = max(1, math.ceil(math.log(1 - TABLE_RECALL) / math.log1p(-(near**per_table))))
    hit = 2 * _normal_cdf(1) - 1
    chances = np.array([math.comb(COUNTED, k) * hit**k * (1 - hit) ** (COUNTED - k) for k in range(COUNTED + 1)])
    count = int(np.flatnonzero(np.cumsum(chances) <= 1 - COUNT_RECALL).max(initial=-1)) + 1
    return Plan(per_table, tables, count, distance)


def _directions(dimensions: int, seed: int, n: int) -> np.ndarray:
    """``n`` random lines as columns, scaled so that projections spread by one."""
    lines = np.random.default_rng([seed, dimensions]).standard_normal((dimensions, n))
    return lines / np.linalg.norm(lines, axis=0) * math.sqrt(dimensions)


def _units(vectors: list[list[float] | None]) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for vector in vectors:
        x = None if vector is None or None in vector else np.asarray(vector, np.float64)
        length = 0.0 if x is None or not np.isfinite(x).all() or not len(x) else float(np.linalg.norm(x / max(np.abs(x).max(), 1e-300)))
        out.append(x / max(np.abs(x).max(), 1e-300) / length if length else None)
    return out


def _dealer(plan: Plan):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket of every vector in every table, none for vectors that link with nothing."""
        for batch in batches:
            units = _units(batch.column("embedding").to_pylist())
            buckets = [None] * len(units)
            for size in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
                places = np.stack([units[i] for i in at]) @ _directions(size, 1, plan.tables * plan.per_table)
                shift = np.random.default_rng([2, size]).random(plan.tables * plan.per_table)
                cells = np.floor(places / CELL + shift).astype(np.int64).view(np.uint64).reshape(len(at), plan.tables, plan.per_table)
                key = np.broadcast_to(mix(np.arange(plan.tables, dtype=np.uint64) + np.uint64(size << 20)), cells.shape[:2])
                for k in range(plan.per_table):
                    key = mix(key ^ mix(cells[:, :, k]) + np.uint64(k))
                for i, row in zip(at, as_signed(key)):
                    buckets[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vector_key"), pa.array(buckets, pa.list_(pa.int64()))], ["vector_key", "buckets"])

    return deal


def _counter(plan: Plan, threshold: float):
    names = ("table", "bucket", "x", "y", "side", "vector_key", "copies", "buckets", "embedding")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(name).to_pylist() for name in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, _, x, y), group in groupby(rows(batches), key=lambda r: r[:4]):
            members = sorted(group, key=lambda r: r[4:6])
            cut = len(members) if x == y else sum(r[4] == 0 for r in members)
            a, b = slice(0, cut), slice(0, cut) if x == y else slice(cut, len(members))
            if cut < 1 or b.stop == b.start or len(members) < 2:
                continue
            units = np.stack(_units([r[8] for r in members]))
            places = units @ _directions(units.shape[1], 3, COUNTED)
            collisions = np.zeros((cut, b.stop - b.start), np.int16)
            for k in range(COUNTED):
                collisions += np.abs(places[a, k][:, None] - places[b, k][None, :]) <= plan.window
            passed = collisions >= plan.count
            buckets = np.array([r[7] for r in members], np.int64)
            for earlier in range(table):  # a pair counts in the first table it shares
                passed &= buckets[a, earlier][:, None] != buckets[b, earlier][None, :]
            if x == y:
                np.fill_diagonal(passed, False)
            i, j = np.nonzero(passed)
            if not len(i):
                continue
            cosine = np.einsum("ij,ij->i", units[a][i], units[b][j])
            passed[i, j] = cosine >= threshold
            whole = np.zeros((len(members), len(members)), bool)
            whole[a, b] = passed
            whole |= whole.T
            degree = whole @ np.array([r[6] for r in members], np.int64)
            root = local_roots(len(members), whole)
            at = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays(
                [pa.array([members[i][5] for i in at], pa.string()), pa.array(degree[at], pa.int64()), pa.array([members[root[i]][5] for i in at], pa.string())],
                ["vector_key", "links", "root"])

    return count


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of near-duplicate embeddings.

    The archive keeps no vectors, so the operator is general: it reads ``object_id`` and
    ``embedding`` (array of numbers) of any table. Vectors are linked if their cosine, in
    double precision, is at least ``threshold``. Returns one row per input row: object_id,
    ``n_links`` (other rows linked directly) and ``component_id`` (smallest object_id that
    links reach, itself included).

    Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, as do vectors of different lengths. Equal vectors are linked, also under one
    object_id. A null object_id is carried through and names no component that has another.
    An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    given = vectors.select("object_id", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = given.withColumn("vector_key", F.concat(F.xxhash64("embedding").cast("string"), F.lit(":"), F.xxhash64(F.lit(1), "embedding").cast("string")))
    folded = keyed.groupBy("vector_key").agg(F.count("*").alias("copies"), F.min("object_id").alias("first_id"), F.first("embedding").alias("embedding"))
    folded = scratch.write(folded, "folded")
    plan = calibrate(folded.count(), threshold)
    dealt = folded.select("vector_key", "embedding").mapInArrow(_dealer(plan), "vector_key string, buckets array<long>")
    dealt = scratch.write(dealt.filter("buckets IS NOT NULL"), "dealt")

    each = dealt.select("vector_key", F.posexplode("buckets").alias("table", "bucket"))
    parts = each.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    parts = parts.select("table", "bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"))
    placed = each.join(parts, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vector_key"), F.col("parts")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "table", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "vector_key")
    full = paired.join(folded.join(dealt, "vector_key").select("vector_key", "copies", "buckets", F.col("embedding").cast("array<double>")), "vector_key")
    counted = scratch.write(
        full.repartition("table", "bucket", "x", "y").sortWithinPartitions("table", "bucket", "x", "y")
        .mapInArrow(_counter(plan, threshold), "vector_key string, links long, root string")
        .groupBy("vector_key", "root").agg(F.sum("links").alias("links")), "counted")

    joined = connected(scratch, counted.select(F.col("vector_key").alias("a"), F.col("root").alias("b")))
    linked = joined.join(folded.select(F.col("vector_key").alias("node"), "first_id"), "node")
    named = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    degrees = counted.groupBy("vector_key").agg(F.sum("links").alias("links"))
    judged = scratch.write(
        dealt.select("vector_key").join(folded.select("vector_key", "copies", "first_id"), "vector_key")
        .join(linked.join(named, "component").select(F.col("node").alias("vector_key"), "least_id"), "vector_key", "left")
        .join(degrees, "vector_key", "left")
        .select("vector_key", F.coalesce("least_id", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "judged")
    scratch.drop(counted, dealt)
    return keyed.select("object_id", "vector_key").join(judged, "vector_key", "left").select(
        "object_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "object_id").alias("component_id"))
