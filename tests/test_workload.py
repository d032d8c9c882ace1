"""Queries on tables that are folders of files, and on ids that look like marks."""

import uuid

import pytest

import __spark_entry__ as entry
from keepsake.functions.ids import DEFAULT_IDS

# The own id of this document begins as the mark of objects stored under another id.
ODD = next(n for n in range(400_000) if n % 50 != 4 and n % 13 != 5
           and uuid.uuid5(DEFAULT_IDS.namespace, f"object:documents:doc-{n}").hex.startswith("0000"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in a folder of three files."""
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(n, f"text {n}", "en", "web", 6) for n in (1, 2, 3, 4, 5, ODD)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def test_stream_reads_a_table_of_several_files(spark, folder):
    rows = entry.queries()["stream_ingest"](spark, folder).collect()
    assert sorted(r["source_id"] for r in rows) == sorted(f"doc-{n}" for n in (1, 2, 3, 4, 5, ODD))
    assert all(r["version"] == 1 for r in rows)


def test_an_id_that_begins_like_the_mark_stays_whole(spark, folder):
    row = entry.queries()["idempotence_report"](spark, folder).first()
    assert (row["n_first"], row["ids_stable"], row["all_unchanged_on_repeat"], row["counts_stable_on_repeat"]) == (6, True, True, True)


@pytest.mark.parametrize("n", [1, 2, 100, 101])
def test_arrivals_are_thirds_of_all_events_without_one_task_for_all(spark, n):
    from workload.streams import ARRIVALS, arrivals

    events = spark.range(n).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(id * 31 % 17) AS ts")
    events.createOrReplaceTempView("some_events")
    told = spark.sql(ARRIVALS.replace("FROM events", "FROM some_events"))
    found = arrivals(spark, events)
    assert sorted(map(tuple, found.select("event_id", "user_id", "ts", "part").collect())) == sorted(map(tuple, told.collect()))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_detection_summary_computes_no_field_it_does_not_return(spark, tmp_path):
    spark.range(4).selectExpr(
        "id AS l_orderkey", "int(id) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "'A' AS l_returnflag", "'O' AS l_linestatus",
        "double(id * 10) AS l_quantity", "0.05D AS l_discount", "0.02D AS l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = entry.queries()["detection_summary"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "semantic_mentions_entity" not in plan
    assert {r["image_id"]: r["confidence"] for r in rows.collect()}["2-2-2-2"] == pytest.approx((0.5 + 0.2) / 2)
