"""Index tables on Parquet and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import AUDIT_COLUMNS, TABLES
from ..operators.quality import align
from ..operators.search import INDEX, ROWS, TERMS, build_index, index_rows, terms_of


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One index table; older layouts gain their missing columns on read."""
    return align(spark.read.parquet(f"{root.rstrip('/')}/{name}"), TABLES[name])


def read_archive(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in (names or TABLES)}


def write_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Write tables below a new directory; readers switch by being given its path.

    Objects and results are laid out by what searches filter on first. Rows are written
    where they are, so that texts are not shuffled once more only to make files even.
    """
    layout = {"objects": ["object_type"], "semantic_results": ["is_current"]}
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if name in layout:
            # Partition columns move to the end on disk; ``align`` restores the order.
            writer = writer.partitionBy(*layout[name])
        writer.parquet(f"{root.rstrip('/')}/{name}")


def write_index(tables: dict[str, DataFrame], root: str, **options) -> None:
    """Write the token index that searches read, beside the tables it is made from.

    Postings are made of the written rows and terms of the written postings, so texts are cut
    into tokens once.
    """
    root = root.rstrip("/")
    rows = index_rows(tables, **options)
    rows.write.mode("errorifexists").parquet(f"{root}/{ROWS}")
    index = build_index(rows.sparkSession.read.parquet(f"{root}/{ROWS}"))
    # Spark splits a bucket that is large, and sorts what it writes by token.
    index.hint("rebalance", "token_bucket").sortWithinPartitions("token_bucket", "token", "row_id").write.mode("errorifexists").partitionBy("token_bucket").parquet(f"{root}/{INDEX}")
    written = index.sparkSession.read.parquet(f"{root}/{INDEX}")
    terms_of(written, **options).write.mode("errorifexists").parquet(f"{root}/{TERMS}")


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in (INDEX, ROWS, TERMS)}


def audit_problem(df: DataFrame) -> str | None:
    """Why a frame is no audit log: every column must be allowed and present."""
    extra = sorted(set(df.columns) - set(AUDIT_COLUMNS))
    missing = sorted(set(AUDIT_COLUMNS) - set(df.columns))
    if extra or missing:
        return f"audit record contains forbidden fields: {extra} or lacks: {missing}"
    return None


def append_audit(df: DataFrame, path: str) -> None:
    problem = audit_problem(df)
    if problem:
        raise ValueError(problem)
    df.select(*AUDIT_COLUMNS).write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A nested report as JSON lines."""
    df.write.mode("errorifexists").json(path)


def outcome_stats(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of the run log: rows per outcome, as a JSON object per key."""
    counted = outcomes.groupBy(*keys).agg(*[
        F.count_if(F.col("outcome") == name).alias(name) for name in ("changed", "conflict", "inserted", "unchanged")
    ])
    stats = F.to_json(F.struct("changed", "conflict", "inserted", "unchanged"))
    return counted.select(*keys, stats.alias("stats_json"))
