"""Ordered per-key work that holds when one key owns a third of all rows.

A plain window puts a whole key into one task. Here the rows of *hot* keys are cut
into chunks of their ordinal first: windows run inside ``(key, chunk)``, and what has
to cross a chunk border is carried by one summary row per chunk. Cold keys stay in a
single chunk and cost one shuffle, as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A key is hot from this many rows on; a chunk spans this many ordinals.
HOT_ROWS = 1_000_000
CHUNK_SPAN = 4_000_000


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(key) for key in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of keys with at least ``hot_rows`` rows; only hashes are counted and shuffled."""
    counted = df.select(key_hash(keys).alias("_hot")).groupBy("_hot").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= hot_rows).select("_hot")


def with_chunks(
    df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """Add ``_chunk``: 0 for cold keys, the ordinal divided by the span for hot ones.

    Of a compound ordinal the leading part is divided.
    """
    hot = hot_keys(df, keys, hot_rows).withColumn("_is_hot", F.lit(True))
    # There are at most as many hot keys as rows / hot_rows, 8 bytes each: 10^11 rows
    # at the default give less than a megabyte.
    marked = df.withColumn("_hot", key_hash(keys)).join(F.broadcast(hot), "_hot", "left")
    kind = df.schema[order].dataType
    leading = f"{order}.{kind.fields[0].name}" if isinstance(kind, StructType) else order
    chunk = F.when(F.col("_is_hot"), F.expr(f"{leading} div {chunk_span}L")).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("_chunk", chunk).drop("_hot")


def ordered_lag(
    df: DataFrame, keys: list[str], order: str, columns: list[str],
    hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN,
) -> DataFrame:
    """Add ``prev_<column>`` of the preceding row of the same key, and ``has_prev``."""
    chunked = with_chunks(df, keys, order, hot_rows, chunk_span)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    payload = F.struct(*[F.col(name) for name in columns])
    local = chunked.withColumn("_inner", F.lag(payload).over(inside))

    tails = (
        chunked.filter(F.col("_is_hot"))
        .groupBy(*keys, "_chunk")
        .agg(F.max_by(payload, F.col(order)).alias("_tail"))
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*keys, "_chunk", F.lag("_tail").over(along).alias("_carried"))
    carried = carried.filter(F.col("_carried").isNotNull())

    joined = local.join(carried, [*keys, "_chunk"], "left")
    previous = F.coalesce(F.col("_inner"), F.col("_carried"))
    return joined.select(
        *df.columns,
        previous.isNotNull().alias("has_prev"),
        *[previous[name].alias(f"prev_{name}") for name in columns],
    )


def ordered_rank(
    df: DataFrame, keys: list[str], order: str, name: str,
    hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN,
) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    chunked = with_chunks(df, keys, order, hot_rows, chunk_span)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn("_rank", F.row_number().over(inside))

    sizes = chunked.filter(F.col("_is_hot")).groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.sum("_rows").over(before).alias("_offset"))
    offsets = offsets.filter(F.col("_offset").isNotNull())

    joined = local.join(offsets, [*keys, "_chunk"], "left")
    position = (F.col("_rank") + F.coalesce(F.col("_offset"), F.lit(0))).cast("long")
    return joined.select(*df.columns, position.alias(name))


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per key, the one with the greatest order; combined before the shuffle."""
    row = F.struct(*[F.col(name) for name in columns])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, order).alias("_row"))
        .select(*keys, *[F.col("_row")[name].alias(name) for name in columns])
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows per key; each task cuts its share before the shuffle."""
    ranking = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranking)).filter(F.col(name) <= limit)
