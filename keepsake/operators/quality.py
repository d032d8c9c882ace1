"""Constraint checks, snapshot comparison and reports: Spark enforces none of these itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contracts import TABLES, Table
from ..functions.redact import leaks


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unique_violations(df: DataFrame, table: str, keys: tuple[str, ...]) -> DataFrame:
    """One row: how many key values occur more than once, and how many rows are too many.

    Keys with a null part are not compared, as in SQL unique indexes.
    """
    full = df
    for key in keys:
        full = full.filter(F.col(key).isNotNull())
    groups = full.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(
        F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")
    ).select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "duplicate_keys", "surplus_rows")


def foreign_key_violations(df: DataFrame, table: str, column: str, parent: DataFrame, parent_table: str, parent_key: str) -> DataFrame:
    """One row: how many references point nowhere."""
    # Distinct references first: a value held by a third of the rows joins as one.
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("n"))
    orphans = counted.join(parent.select(F.col(parent_key).alias("_ref")), "_ref", "left_anti")
    return orphans.agg(
        F.count("*").alias("missing_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")
    ).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(parent_table).alias("parent_table"),
        "missing_keys", "orphan_rows",
    )


def check_violations(df: DataFrame, table: str, contract: Table) -> DataFrame:
    """Rows per value rule and per required column, all counted in one pass."""
    rules = {f"check:{name}": f"NOT coalesce({rule}, true)" for name, rule in contract.checks.items() if name in df.columns}
    rules |= {f"required:{name}": f"{name} IS NULL" for name in contract.required if name in df.columns}
    counted = df.agg(*[F.count_if(F.expr(rule)).alias(f"c{i}") for i, rule in enumerate(rules.values())])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(rules)
    ])
    return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))


def all_unique(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        unique_violations(df, name, keys) for name, df in tables.items() for keys in TABLES[name].unique
    ])


def all_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        foreign_key_violations(df, name, column, tables[parent], parent, key)
        for name, df in tables.items()
        for column, (parent, key) in TABLES[name].references.items()
        if parent in tables and column in df.columns
    ])


def all_checks(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([check_violations(df, name, TABLES[name]) for name, df in tables.items()])


def more_than_one_current(results: DataFrame) -> DataFrame:
    """Object, extractor and type with several current results."""
    keys = ["object_id", "extractor_name", "semantic_type"]
    counted = results.groupBy(*keys).agg(F.count_if(F.col("is_current")).alias("n_current"))
    return counted.filter("n_current > 1")


def person_edges(relations: DataFrame) -> DataFrame:
    """Number of relations that name a person; the archive must have none."""
    return relations.agg(F.count_if(F.col("relation_type") == "semantic_mentions_person").alias("person_edges"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ])


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    old = before.select(*keys, F.struct(*columns).alias("_old"))
    new = after.select(*keys, F.struct(*columns).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return joined.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def hash_audit(objects: DataFrame, digests: DataFrame) -> DataFrame:
    """Objects whose stored hash is not that of the content found, or whose content is gone."""
    joined = objects.select("object_id", "raw_uri", "content_hash").join(
        digests.select("raw_uri", F.col("sha256").alias("actual_hash")), "raw_uri", "left"
    )
    state = (
        F.when(F.col("actual_hash").isNull(), "missing")
        .when(F.col("actual_hash") != F.col("content_hash"), "mismatch")
        .otherwise("ok")
    )
    return joined.select("object_id", state.alias("state"))


def rank_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per query: do two rankings hold the same objects at the same ranks?"""
    pairs = left.select("query_id", "rank", F.col("object_id").alias("_l")).join(
        right.select("query_id", "rank", F.col("object_id").alias("_r")), ["query_id", "rank"], "full_outer"
    )
    return pairs.groupBy("query_id").agg(
        F.count("*").alias("n_ranks"), F.bool_and(F.col("_l").eqNullSafe(F.col("_r"))).alias("rank_matches")
    )


def leak_report(public: DataFrame, columns: list[str], rules: str = "client") -> DataFrame:
    """How many rows of each public column hold private data; must be zero."""
    counted = public.agg(*[F.count_if(leaks(F.col(name), rules)).alias(name) for name in columns])
    pairs = F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("leaking_rows")) for name in columns])
    return counted.select(F.inline(pairs))


def schema_issues(df: DataFrame, contract: Table) -> list[str]:
    """Columns a table lacks or holds in another type."""
    expected = {item.name: item.dataType for item in StructType.fromDDL(contract.schema)}
    present = {item.name: item.dataType for item in df.schema}
    missing = [f"missing column: {name}" for name in expected if name not in present]
    other = [
        f"type of {name}: {present[name].simpleString()}" for name, kind in expected.items()
        if name in present and present[name] != kind
    ]
    return missing + other


def align(df: DataFrame, contract: Table) -> DataFrame:
    """An older table in today's layout: missing columns added with their defaults."""
    columns = []
    for item in StructType.fromDDL(contract.schema):
        if item.name in df.columns:
            columns.append(F.col(item.name).cast(item.dataType).alias(item.name))
        else:
            columns.append(F.lit(contract.defaults.get(item.name)).cast(item.dataType).alias(item.name))
    return df.select(*columns)


def stored_version(tables: dict[str, DataFrame]) -> int:
    """The layout version an archive says it has; 0 if it says none."""
    if "schema_migrations" not in tables:
        return 0
    return tables["schema_migrations"].agg(F.max("version")).first()[0] or 0


def health_report(spark: SparkSession, tables: dict[str, DataFrame], probe_hits: DataFrame | None,
                  schema_version: int, expected_version: int) -> DataFrame:
    """One row: versions, counts, whether search answers, and the issues found."""
    counted = ("objects", "blobs", "attachments", "semantic_results", "metadata_extractions")
    issues = [] if schema_version == expected_version else [
        f"schema_version {schema_version} does not match expected {expected_version}"
    ]
    issues += [f"table is missing: {name}" for name in counted if name not in tables]
    issues += [
        f"{name}: {issue}" for name in counted if name in tables
        for issue in schema_issues(tables[name], TABLES[name]) if issue.startswith("type of")
    ]
    if probe_hits is None:
        issues.append("read-only search is unavailable")
    unavailable = "objects" not in tables
    row = spark.range(1).select(
        F.lit(not unavailable).alias("database_available"),
        F.lit(schema_version).alias("schema_version"),
        F.lit(schema_version == expected_version).alias("schema_up_to_date"),
        F.lit(probe_hits is not None).alias("search_available"),
        F.lit("; ".join(issues)).alias("issues"),
        F.lit("ERROR" if unavailable else "WARNING" if issues else "OK").alias("status"),
    )
    # One-row tables side by side, as scalar subqueries: nothing to shuffle.
    for name in counted:
        if name in tables:
            row = row.withColumn(f"n_{name}", tables[name].agg(F.count("*")).scalar())
    if probe_hits is not None:
        row = row.withColumn("probe_hits", probe_hits.agg(F.count("*")).scalar())
    return row
