"""Ordered work on hot keys gives what a plain window gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators.hotkeys import latest, ordered_lag, ordered_rank, top_rows
from keepsake.operators.upsert import append_versions, classify

HOT = {"hot_rows": 50, "chunk_span": 64}


def skewed(spark, rows=3000):
    """A third of the rows belong to one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    return spark.range(rows).select(key.alias("k"), F.col("id").alias("ordinal"), (F.col("id") % 11).cast("string").alias("v"))


def as_set(df):
    return {tuple(row) for row in df.collect()}


def test_ordered_lag_equals_window(spark):
    df = skewed(spark)
    window = Window.partitionBy("k").orderBy("ordinal")
    expected = df.select("ordinal", F.lag("v").over(window).alias("prev_v"))
    got = ordered_lag(df, ["k"], "ordinal", ["v"], **HOT).select("ordinal", "prev_v")
    assert as_set(got) == as_set(expected)


def test_ordered_rank_equals_window(spark):
    df = skewed(spark)
    window = Window.partitionBy("k").orderBy("ordinal")
    expected = df.select("ordinal", F.row_number().over(window).cast("long").alias("nth"))
    assert as_set(ordered_rank(df, ["k"], "ordinal", "nth", **HOT).select("ordinal", "nth")) == as_set(expected)


def test_hot_key_is_really_chunked(spark):
    from keepsake.operators.hotkeys import with_chunks

    chunks = with_chunks(skewed(spark), ["k"], "ordinal", **HOT)
    assert chunks.filter("k = 'hot'").select("_chunk").distinct().count() > 10
    assert chunks.filter("k <> 'hot'").select("_chunk").distinct().count() == 1


def test_latest_and_top_rows(spark):
    df = skewed(spark)
    assert latest(df, ["k"], F.col("ordinal"), ["ordinal"]).filter("k = 'hot'").first()["ordinal"] == 2997
    top = top_rows(df, ["k"], [F.col("ordinal").desc()], 2).filter("k = 'hot'")
    assert sorted(row["ordinal"] for row in top.collect()) == [2994, 2997]


def deliveries(spark, rows=2000):
    """One hot object delivered again and again, its content changing in cycles."""
    source_id = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")))
    return spark.range(rows).select(
        F.lit("src").alias("source"), source_id.alias("source_id"), F.concat(F.lit("o-"), source_id).alias("object_id"),
        F.concat(F.lit("h"), (F.floor(F.col("id") / 4) % 37).cast("string")).alias("content_hash"), F.col("id").alias("ordinal"),
    ).withColumn("fingerprint", F.col("content_hash"))


def simulate(rows, stored):
    """Row by row, the way deliveries are defined."""
    state, known, version, outcomes, versions = dict(stored), {}, {}, {}, set()
    for (source_id, digest) in stored.items():
        known[source_id], version[source_id] = {digest}, 1
    for row in rows:
        key, digest = row["source_id"], row["content_hash"]
        before = state.get(key)
        outcomes[row["ordinal"]] = "inserted" if before is None else "unchanged" if before == digest else "changed"
        state[key] = digest
        if digest not in known.setdefault(key, set()):
            known[key].add(digest)
            version[key] = version.get(key, 0) + 1
            versions.add((row["object_id"], digest, version[key]))
    return outcomes, versions


def test_classify_and_versions_equal_row_by_row(spark):
    incoming = deliveries(spark)
    stored = spark.createDataFrame([("src", "hot", "o-hot", "h3"), ("src", "s1", "o-s1", "zz")], "source string, source_id string, object_id string, content_hash string")
    stored = stored.withColumn("fingerprint", F.col("content_hash"))
    expected, expected_versions = simulate(incoming.orderBy("ordinal").collect(), {"hot": "h3", "s1": "zz"})
    outcomes = classify(incoming, stored, **HOT)
    assert {row["ordinal"]: row["outcome"] for row in outcomes.collect()} == expected
    versions = stored.select("object_id", "content_hash", F.lit(1).alias("version"))
    new = append_versions(versions, outcomes, hot_rows=5, chunk_span=64).select("object_id", "content_hash", "version")
    assert as_set(new) == expected_versions


def test_other_id_for_stored_key_is_a_conflict(spark):
    incoming = deliveries(spark, 10)
    stored = incoming.filter("source_id = 'hot'").limit(1).withColumn("object_id", F.lit("other"))
    found = classify(incoming, stored).filter("source_id = 'hot'").select("outcome").distinct().collect()
    assert [row["outcome"] for row in found] == ["conflict"]
