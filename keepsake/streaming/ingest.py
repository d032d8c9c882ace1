"""Incremental ingest: micro-batches of items merged into keyed state.

The state is a snapshot log of its own: objects and known versions, dealt to buckets by key.
A micro-batch reads and rewrites the buckets of its keys and no others, and commits under its number;
run again after a failure, a batch that was committed does nothing, and one that was not
starts from the state before it. So work follows the batch, not the life of the stream.

Beside it, the delivery log keeps the outcome rows of each batch in a directory of its own,
for reports; no batch reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import OBJECT_COLUMNS
from ..plans.ingest import identify, ingest_identified, split_items
from ..session import materialise
from ..sources.snapshots import SnapshotLog

LOG_SCHEMA = (
    "object_id string, object_type string, source string, source_id string, occurred_at string, captured_at string, "
    "parent_id string, raw_uri string, content_hash string, mime_type string, topic string, metadata_json string, "
    "created_at string, ordinal bigint, blob_id string, byte_size bigint, outcome string, version bigint"
)


def read_log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All logged deliveries, or those of the batches before the given one."""
    schema = StructType.fromDDL(LOG_SCHEMA + ", batch bigint")
    try:
        log = spark.read.schema(schema).option("basePath", root).parquet(root)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], schema)
    return log if before is None else log.filter(F.col("batch") < before)


def rejects_of(root: str) -> str:
    """Where the rejected items of a log are kept."""
    return f"{root.rstrip('/')}-rejects"


def objects_of(log: DataFrame) -> DataFrame:
    """Present objects: per object the last row that inserted or changed it, created with the first."""
    written = log.filter(F.col("outcome").isin("inserted", "changed"))
    place = F.struct("batch", "ordinal")
    row = F.struct(*[name for name in OBJECT_COLUMNS if name not in ("object_id", "created_at")])
    found = written.groupBy("object_id").agg(F.max_by(row, place).alias("row"), F.min_by("created_at", place).alias("created_at"))
    return found.select("object_id", "row.*", "created_at").select(*OBJECT_COLUMNS)


def versions_of(log: DataFrame) -> DataFrame:
    return log.filter("version IS NOT NULL").select("object_id", "content_hash", "version")


STATE_BUCKETS = 256
STATE_SCHEMAS = {
    "objects": ", ".join(f"{name} string" for name in OBJECT_COLUMNS),
    "object_versions": "object_id string, content_hash string, version bigint",
}


def state_of(spark: SparkSession, root: str, buckets: int = STATE_BUCKETS) -> SnapshotLog:
    """The keyed state beside a delivery log: tables ``objects`` and ``object_versions``."""
    return SnapshotLog(spark, f"{root.rstrip('/')}-state", buckets, schemas=STATE_SCHEMAS)


def _batch_of(label: str | None) -> int:
    """The number of the batch a snapshot was committed by; -1 before the first."""
    return int(label) if label is not None else -1


def merge_batch(batch: DataFrame, batch_id: int, root: str, buckets: int = STATE_BUCKETS, most_parts: int = 8, **hot) -> None:
    """Merge one micro-batch into the state, and write its outcomes to the delivery log.

    Rejected items are kept with their reason, in a table of their own beside the log. The
    state holds known versions in parts, one per batch and bucket; a bucket that this batch
    touches and that has more than ``most_parts`` is written anew as one.
    """
    spark = batch.sparkSession
    state = state_of(spark, root, buckets)
    base = state.current()
    if _batch_of(base.label) >= batch_id:
        return
    valid, rejected = split_items(batch)
    rejected.drop("content").write.mode("overwrite").parquet(f"{rejects_of(root)}/batch={batch_id}")
    incoming = materialise(identify(valid), "deliveries")
    near = {name: state.touched(name, incoming) for name in STATE_SCHEMAS}
    objects, versions = (state.read(name, base, near[name]) for name in STATE_SCHEMAS)
    result = ingest_identified(incoming, objects, versions, **hot)
    # A version row belongs to the delivery that brought it, whose ordinal others may repeat.
    delivery = ["ordinal", "object_id", "content_hash"]
    new_versions = materialise(result.new_versions.select(*delivery, "version"), "new-versions")
    rows = result.outcomes.join(new_versions.dropDuplicates(delivery), delivery, "left").withColumn("created_at", F.col("captured_at"))
    for name in ("parent_id", "topic"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    columns = [item.name for item in StructType.fromDDL(LOG_SCHEMA)]
    rows.select(*columns).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    held = base.parts.get("object_versions", {})
    crowded = [key for key in near["object_versions"] if len(held.get(str(key), [])) >= most_parts]
    in_crowded = state.bucket("object_versions").isin(crowded) if crowded else F.lit(False)
    fresh = new_versions.select("object_id", "content_hash", "version")
    anew = state.read("object_versions", base, crowded).unionByName(fresh.filter(in_crowded))
    replaced = {"objects": (near["objects"], state.stage("objects", result.objects))}
    if crowded:
        replaced["object_versions"] = (crowded, state.stage("object_versions", anew))
    state.commit(base, replaced, {"object_versions": state.stage("object_versions", fresh.filter(~in_crowded))}, label=str(batch_id))


def start(items: DataFrame, root: str, checkpoint: str, available_now: bool = True, **hot):
    """Run the merge over a stream of items (columns of ``plans.ingest`` plus ``ordinal``)."""
    writer = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, root, **hot)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
