"""Tables that change together: staged parts and a log of snapshots.

An archive is a folder. ``tables`` holds immutable Parquet parts, ``log`` one small file per
snapshot that names, for every table and bucket of keys, the parts it consists of. A job
stages new parts, which nobody sees, and commits them all by creating the next log file;
that succeeds for one writer only. So readers see all tables of a job or none, a
killed job leaves the last snapshot as it was, and a merge rewrites only the buckets
whose keys it touches.

``runs`` holds one small file for every run that started or failed; that a run is
complete is part of the snapshot it committed.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contracts import TABLES
from ..operators.hotkeys import latest

BUCKETS = 256
# Columns whose hash says in which bucket a row is; tables without keys are only appended to.
KEYS = {
    "objects": ("source", "source_id"), "object_versions": ("object_id",), "relations": ("to_object_id",),
    "blobs": ("blob_id",), "attachments": ("object_id",), "blob_locations": ("object_id",), "import_diagnostics": (),
    "metadata_extractions": ("object_id",), "metadata_diagnostics": (),
    "semantic_results": ("object_id",), "semantic_relations": ("object_id",), "semantic_runs": ("object_id",), "item_outcomes": (),
}
# Tables beside those of the index: which result each extractor run led to, and what became of listed items.
SCHEMAS = {
    "semantic_runs": "object_id string, extractor_name string, semantic_type string, semantic_result_id string, run_seq bigint",
    "item_outcomes": "import_id string, filename string, source_id string, object_id string, ingestion_outcome string, semantic_status string, error string",
}
RUN_SCHEMA = TABLES["import_runs"].schema


class CommitConflict(Exception):
    """Another writer committed the snapshot this one would have been; merge again."""


@dataclass(frozen=True)
class Snapshot:
    """``parts`` by table and bucket; ``label`` tells what made it."""

    seq: int = 0
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    label: str | None = None


class _Files:
    """The few small files of a log, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(root).makeQualified(self.system.getUri(), self.system.getWorkingDirectory()).toUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        if not self.system.exists(self.path(folder)):
            return []
        return [status.getPath().getName() for status in self.system.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was not there and now is, with all its text."""
        staged = self.path(f"{name}.{uuid.uuid4().hex}.staged")
        stream = self.system.create(staged, True)
        stream.write(text.encode())
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            # Refused if the target exists.
            self.context.rename(self._qualified(staged), self._qualified(self.path(name)), self._no_options(kind))
            return True
        except Py4JJavaError as error:
            self.system.delete(staged, False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def _qualified(self, path):
        return path.makeQualified(self.system.getUri(), self.system.getWorkingDirectory())

    def _no_options(self, kind):
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(kind, 0)


class SnapshotLog:
    """The snapshots of one archive folder.

    ``keys`` and ``schemas`` name tables beside those of the archive index, or replace them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS,
                 keys: dict[str, tuple[str, ...]] | None = None, schemas: dict[str, str] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys = {**KEYS, **(keys or {})}
        self.schemas = {**{name: table.schema for name, table in TABLES.items()}, **SCHEMAS, **(schemas or {})}
        self.files = _Files(spark, self.root)

    # Reading

    def _entry(self, seq: int) -> str:
        return f"{self.root}/log/{seq:012d}.json"

    def sequence(self) -> list[int]:
        return sorted(int(name[:12]) for name in self.files.names(f"{self.root}/log") if name.endswith(".json") and name[:12].isdigit())

    def current(self, seq: int | None = None) -> Snapshot:
        """The last snapshot, or the one asked for; an archive without any is empty."""
        known = self.sequence()
        if seq is None and not known:
            return Snapshot()
        entry = json.loads(self.files.read(self._entry(known[-1] if seq is None else seq)))
        return Snapshot(entry["seq"], entry["parts"], entry["label"])

    def read(self, name: str, snapshot: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a snapshot, or only some buckets of it: the others are not opened."""
        snapshot = self.current() if snapshot is None else snapshot
        held = snapshot.parts.get(name, {})
        wanted = held if buckets is None else [key for key in map(str, buckets) if key in held]
        paths = [f"{self.root}/{part}" for key in wanted for part in held[key]]
        schema = StructType.fromDDL(self.schemas[name])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """The run log: per run its last state. What started and neither ended nor failed is running."""
        schema = StructType.fromDDL(RUN_SCHEMA)
        rank = F.when(F.col("status") == "running", 0).otherwise(1)
        rows = self.spark.createDataFrame([], schema)
        if self.files.names(f"{self.root}/runs"):
            rows = rows.unionByName(self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/runs"))
        if self.sequence():
            ended = self.spark.read.schema(f"run struct<{RUN_SCHEMA.replace(' string', ': string')}>").option("pathGlobFilter", "*.json").json(f"{self.root}/log")
            rows = rows.unionByName(ended.filter("run IS NOT NULL").select("run.*"))
        return latest(rows, ["import_id"], rank, [name for name in schema.names if name != "import_id"])

    # Writing

    def bucket(self, name: str, columns: tuple[str, ...] | None = None) -> Column:
        """The bucket of a row of this table; ``columns`` if its keys have other names."""
        keys = columns or self.keys[name]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int") if keys else F.lit(0)

    def touched(self, name: str, rows: DataFrame, columns: tuple[str, ...] | None = None) -> list[int]:
        """Buckets of the keys in ``rows``: at most as many numbers as there are buckets."""
        return sorted(row[0] for row in rows.select(self.bucket(name, columns)).distinct().collect())

    def stage(self, name: str, rows: DataFrame, beside: dict[str, str] | None = None) -> dict[str, str]:
        """Write rows as a new part of each bucket they fall into; nobody sees them yet.

        ``beside`` are columns, with their types, that only ``staged`` reads again.
        """
        part = f"tables/{name}/{uuid.uuid4().hex}"
        columns = [*StructType.fromDDL(self.schemas[name]).names, *(beside or {})]
        out = rows.select(*columns, self.bucket(name).alias("_bucket"))
        # Files are even whatever bucket is large: Spark splits it among tasks.
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{part}")
        found = [n.removeprefix("_bucket=") for n in self.files.names(f"{self.root}/{part}") if n.startswith("_bucket=")]
        return {key: f"{part}/_bucket={key}" for key in found}

    def staged(self, name: str, parts: dict[str, str], beside: dict[str, str] | None = None) -> DataFrame:
        """The rows of staged parts, with the columns that were written beside those of the table."""
        schema = StructType.fromDDL(", ".join([self.schemas[name], *[f"{column} {kind}" for column, kind in (beside or {}).items()]]))
        paths = [f"{self.root}/{part}" for part in parts.values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, base: Snapshot, replaced: dict[str, tuple[list[int], dict[str, str]]] | None = None,
               appended: dict[str, dict[str, str]] | None = None, label: str | None = None, run: dict | None = None) -> Snapshot:
        """Make staged parts the next snapshot after ``base``.

        ``replaced``: per table the buckets that were rewritten, and their new parts (a bucket
        without one is empty now). ``appended``: parts that come beside those that are there.
        """
        parts = {name: dict(held) for name, held in base.parts.items()}
        for name, (buckets, staged) in (replaced or {}).items():
            held = parts.setdefault(name, {})
            for key in map(str, buckets):
                held.pop(key, None)
                if key in staged:
                    held[key] = [staged[key]]
        for name, staged in (appended or {}).items():
            held = parts.setdefault(name, {})
            for key, part in staged.items():
                held[key] = [*held.get(key, []), part]
        entry = {"seq": base.seq + 1, "label": label, "run": run, "parts": parts}
        if not self.files.create(self._entry(base.seq + 1), json.dumps(entry, sort_keys=True)):
            raise CommitConflict(f"snapshot {base.seq + 1} of {self.root} exists")
        return Snapshot(base.seq + 1, parts, label)

    @contextlib.contextmanager
    def run(self, row: dict) -> Iterator[dict]:
        """Note a run as running before its work, and as failed if the work raises.

        The work itself notes it as complete, by committing with the row as ``run``.
        """
        names = StructType.fromDDL(RUN_SCHEMA).names
        started = {name: row.get(name) for name in names} | {"status": "running"}
        self.files.create(f"{self.root}/runs/{row['import_id']}-running.json", json.dumps(started))
        try:
            yield started
        except Exception as error:
            failed = started | {"status": "failed", "error": str(error)[:4000], "completed_at": row.get("completed_at") or started["started_at"]}
            self.files.create(f"{self.root}/runs/{row['import_id']}-failed.json", json.dumps(failed))
            raise

    def compact(self, name: str, most_parts: int = 8) -> Snapshot:
        """Rewrite buckets of an appended table that have more parts than this."""
        base = self.current()
        crowded = [int(key) for key, held in base.parts.get(name, {}).items() if len(held) > most_parts]
        if not crowded:
            return base
        staged = self.stage(name, self.read(name, base, crowded))
        return self.commit(base, {name: (crowded, staged)}, label=f"compact {name}")

    def expire(self, keep: int = 10) -> int:
        """Delete parts that none of the last ``keep`` snapshots needs; the log itself stays."""
        known = self.sequence()
        used = {part for seq in known[-keep:] for held in self.current(seq).parts.values() for paths in held.values() for part in paths}
        gone = {part for seq in known[:-keep] for held in self.current(seq).parts.values() for paths in held.values() for part in paths} - used
        for part in gone:
            self.files.delete(f"{self.root}/{part}")
        return len(gone)
