"""Validation jobs: run twice, compare, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import snapshot_diff
from ..session import materialise
from .ingest import ingest


def idempotence_report(first: DataFrame, second: DataFrame, counts_first: DataFrame, counts_second: DataFrame,
                       id_column: str, outcome_column: str = "outcome") -> DataFrame:
    """One row of checks over two runs on the same input."""
    ids_a, ids_b = first.select(id_column).distinct(), second.select(id_column).distinct()
    side = ids_a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        ids_b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1))
    )
    both = side.groupBy(id_column).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    stable = both.agg(F.count_if(F.col("a") != F.col("b")).alias("n")).scalar()
    repeat = second.agg(F.count_if(F.col(outcome_column) != "unchanged").alias("n")).scalar()
    moved = snapshot_diff(counts_first, counts_second, ["table_name"], ["n_rows"]).agg(F.count("*").alias("n")).scalar()
    return first.agg(F.count("*").alias("n_first")).select(
        "n_first",
        (stable == 0).alias("ids_stable"),
        (repeat == 0).alias("all_unchanged_on_repeat"),
        (moved == 0).alias("counts_stable_on_repeat"),
    )


def ingest_twice(items: DataFrame, objects: DataFrame, versions: DataFrame):
    """The same batch against the stored state and against the state it leads to.

    The state in between is written, as it is between two real runs.
    """
    first = ingest(items, objects, versions)
    state = materialise(first.objects, "state-objects")
    grown = materialise(versions.unionByName(first.new_versions.select(*versions.columns)), "state-versions")
    return first, state, grown, ingest(items, state, grown)


def provider_roundtrip(listing: DataFrame, first: DataFrame, second: DataFrame, objects: DataFrame) -> DataFrame:
    """Per listed item: do identity, URI and provider metadata survive two imports?"""
    one = first.select("source_id", F.col("object_id").alias("first_id"), F.col("outcome").alias("first_outcome"))
    two = second.select("source_id", F.col("object_id").alias("repeat_id"), F.col("outcome").alias("repeat_outcome"))
    kept = objects.select("source_id", F.col("raw_uri").alias("kept_uri"), F.col("metadata_json").alias("kept_json"))
    joined = listing.join(one, "source_id", "left").join(two, "source_id", "left").join(kept, "source_id", "left")
    same = lambda path: F.get_json_object("kept_json", path).eqNullSafe(F.get_json_object("metadata_json", path))
    preserved = F.lit(True)
    for name in ("drive_file_id", "drive_md5_checksum", "drive_modified_time", "drive_version"):
        preserved = preserved & same(f"$.{name}")
    return joined.select(
        "source_id", "first_outcome", "repeat_outcome",
        F.coalesce(F.col("first_id") == F.col("repeat_id"), F.lit(False)).alias("stable_object_id"),
        F.coalesce(F.col("kept_uri") == F.col("raw_uri"), F.lit(False)).alias("raw_uri_matches"),
        F.split_part("kept_uri", F.lit(":"), F.lit(1)).alias("raw_uri_scheme"),
        (F.col("kept_json").isNotNull() & preserved).alias("provider_metadata_preserved"),
    )
