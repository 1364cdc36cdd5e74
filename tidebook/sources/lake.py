"""Storage of the change log: Parquet files that exist once a commit names them.

A micro-batch writes its bronze and reject rows under (stream_epoch, batch_id, attempt_id) and the rows of the state buckets
that it touches, and then commits them all at once with its row of the batch log (``sources/commits.py``).  A half-written
batch can't be seen, a replay takes the place of its predecessor, and files that no commit names are the orphans.

The commit keeps the range of log positions of each file.  An event's id comes from its key and position, so an event above its
key's position was never seen, and one below can only be in files whose range holds its position: the look-up of repeats opens
those files, however long the history is.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.sources.commits import CommitLog, DataFile, Snapshot

ATTEMPT = ["stream_epoch", "batch_id", "attempt_id"]
KEY = ["source_table", "primary_key"]
BUCKETS = 16  # of the current state, by key
MANY_POSITIONS = 10_000  # positions behind their keys up to which a batch's look-up knows each, not only their range
MANY_SEGMENTS = 16
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "date": T.DateType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "map<string;long>": T.MapType(T.StringType(), T.LongType()), "double": T.DoubleType()}


def schema(columns: str) -> T.StructType:
    """Of ``name type`` pairs; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


_DECODED = "contract_name string, contract_version int, source_table string, primary_key string, op string, source_lsn long, source_tx_id long, source_ts timestamp, source_ts_ms long, source_snapshot string, debezium_ts timestamp, before_json string, after_json string, event_id string, drift_fields array<string>"
_KAFKA = "kafka_topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp"
BRONZE_SCHEMA = schema(f"{_KAFKA}, {_DECODED}, is_late boolean, apply_outcome string, previous_lsn long, injection_id string, replay_of string, committed_at timestamp, source_date date, stream_epoch string, batch_id long, attempt_id string")
REJECT_SCHEMA = schema(f"{_KAFKA}, source_topic string, contract_name string, status string, error_code string, error_detail string, violations array<string>, raw_key string, raw_value string, injection_id string, replay_of string, dlq_id string, is_replay boolean, replay_position string, outcome string, stream_epoch string, batch_id long, attempt_id string")
LOG_SCHEMA = schema("pipeline string, stream_epoch string, batch_id long, attempt_id string, spark_app_id string, started_at timestamp, committed_at timestamp, duration_ms long, stage_ms map<string;long>, input_rows long, valid_rows long, dlq_rows long, tombstones long, duplicates long, applied long, superseded long, stale long, late_rows long, commit_retries long, kafka_offsets string, watermark_ms long, max_source_ts_ms long, freshness_p50_ms long, freshness_p95_ms long, freshness_max_ms long, contract_versions string, contracts string, freshness_sketch string, added_data_files long, added_files_bytes long")
STATE_SCHEMA = schema("source_table string, primary_key string, image_json string, is_row boolean, is_deleted boolean, deleted_at timestamp, _source_lsn long, _prev_source_lsn long, _source_ts timestamp, _source_op string, _event_id string, _contract_version int, _batch_id long, _stream_epoch string, _ingested_at timestamp")
HISTORY_SCHEMA = T.StructType([*schema("version long, at timestamp, kind string, app string, added_files long, removed_files long"), *LOG_SCHEMA])


def key_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


class Lake:
    """The tables of one pipeline under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, pipeline: str = "cdc", buckets: int = BUCKETS):
        self.spark, self.root, self.pipeline, self.buckets = spark, root.rstrip("/"), pipeline, buckets
        self.commits = CommitLog(spark, self.root, self._write_history)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mergeSchema", "true").parquet(path)

    def append(self, name: str, rows: DataFrame, *by: str) -> None:
        """To a plain table beside the committed ones."""
        rows.write.mode("append").partitionBy(*by).parquet(self._path(name)) if by else rows.write.mode("append").parquet(self._path(name))

    # ---- commits ------------------------------------------------------------------------------------------------------

    def snapshot(self, version: int | Snapshot | None = None) -> Snapshot:
        return version if isinstance(version, Snapshot) else self.commits.snapshot(version)

    def read_files(self, files: list[DataFile], schema: T.StructType, base: str) -> DataFrame:
        """Rows of data files that lie under the folder ``base``, whose partition columns come from their paths."""
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self._path(base)).parquet(*[self._path(f.path) for f in files])
        return rows.select([f.name for f in schema])

    def written_files(self, table: str, folder: str, attempt: tuple | None = None, low: int | None = None, high: int | None = None) -> list[DataFile]:
        """The Parquet files below a folder (``*`` stands for any name), as a commit names them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(folder)}/*.parquet")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        out = []
        for f in found:
            whole = f.getPath().toUri().getPath()
            path = whole[whole.rindex(f"/{folder.split('/')[0]}/") + 1 :]
            parts = dict(x.split("=", 1) for x in path.split("/") if "=" in x)
            out.append(DataFile(table, path, f.getLen(), parts.get("source_date"), low, high, attempt, int(parts["bucket"]) if "bucket" in parts else None))
        return out

    def commit_batch(self, base: Snapshot, row: dict, files: list[DataFile], state_buckets: list[int] = (), columns: dict | None = None) -> Snapshot:
        """Make a batch attempt visible: its files take the place of those of an earlier attempt, its state files of those of
        the same buckets.  Another batch that came meanwhile is a ``Conflict``, as this one was planned without it."""
        key = (row["stream_epoch"], row["batch_id"])
        touched = set(state_buckets)

        def make(now: Snapshot) -> dict:
            old = [f for f in now.files.values() if f.attempt and f.attempt[:2] == key and f.table != "state"]
            before = self.earlier_attempts(now, *key)
            packed = sorted(a for a in before if a not in {f.attempt for f in old} | now.dead)
            state = [f.path for f in now.table("state") if f.bucket in touched]
            return {"add": [vars(f) for f in files], "remove": [f.path for f in old] + state, "dead": packed, "columns": columns or {}, "batch": {k: v.timestamp() if isinstance(v, dt.datetime) else v for k, v in row.items()}}

        return self.commits.commit(base, "batch", lambda other, now: other["kind"] != "batch", make, row["spark_app_id"])

    def earlier_attempts(self, now: Snapshot, epoch: str, batch_id: int) -> list[tuple]:
        """Earlier attempts of a batch; the whole history is asked only for a batch that is long past."""
        known = now.batches.get((epoch, batch_id))
        if known:
            return [(epoch, batch_id, known["attempt"])]
        if not any(e == epoch and b > batch_id for e, b in now.batches):
            return []
        return [tuple(r) for r in self.log().where((F.col("stream_epoch") == epoch) & (F.col("batch_id") == batch_id)).select(*ATTEMPT).collect()]

    # ---- batch log ----------------------------------------------------------------------------------------------------

    def _tail(self, now: Snapshot) -> DataFrame:
        stamp = lambda s: None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc)
        rows = []
        for c in now.tail:
            batch = c["batch"] or {}
            values = [stamp(batch.get(f.name)) if isinstance(f.dataType, T.TimestampType) else batch.get(f.name) for f in LOG_SCHEMA]
            rows.append((c["version"], stamp(c["at"]), c["kind"], c["app"], c["added_files"], c["removed_files"], *values))
        return self.spark.createDataFrame(rows, HISTORY_SCHEMA)

    def _write_history(self, now: Snapshot) -> list[str]:
        """The snapshot's history as segments: one more, or all in one where they are many."""
        path = f"history/{now.version:020d}-{uuid.uuid4().hex}"
        many = len(now.segments) >= MANY_SEGMENTS
        rows = self._history(now) if many else self._tail(now)
        rows.coalesce(1).write.parquet(self._path(path))
        return [path] if many else [*now.segments, path]

    def _history(self, now: Snapshot) -> DataFrame:
        if not now.segments:
            return self._tail(now)
        old = self.spark.read.schema(HISTORY_SCHEMA).parquet(*[self._path(s) for s in now.segments])
        return old.unionByName(self._tail(now)) if now.tail else old

    def history(self) -> DataFrame:
        """version, at, kind, app, added_files, removed_files, and the columns of the log row where the commit is a batch."""
        return self._history(self.snapshot())

    def newest_by(self, app: str) -> DataFrame:
        """The newest commit of an application, or the newest of all where it has none."""
        rows = self.history()
        return rows.orderBy((F.col("app") == app).desc(), F.col("version").desc()).limit(1)

    def log(self) -> DataFrame:
        """A row for each committed batch attempt."""
        return self.history().where("kind = 'batch'").select([f.name for f in LOG_SCHEMA])

    def committed(self) -> DataFrame:
        """stream_epoch, batch_id, attempt_id: of the last committed attempt of each batch."""
        rows = self.history().where("kind = 'batch'")
        return rows.groupBy("stream_epoch", "batch_id").agg(F.max_by("attempt_id", "version").alias("attempt_id"))

    # ---- tables -------------------------------------------------------------------------------------------------------

    def bronze(self, version: int | Snapshot | None = None, files: list[DataFile] | None = None) -> DataFrame:
        """Committed events, at a version on request, or those of some of the files."""
        now = self.snapshot(version)
        chosen = now.table("bronze") if files is None else files
        raw = self.read_files([f for f in chosen if f.attempt], BRONZE_SCHEMA, "bronze")
        packed = [f for f in chosen if not f.attempt]
        if not packed:
            return raw
        rows = self.read_files(packed, BRONZE_SCHEMA, "packed")
        if now.dead:  # attempts that were run again after their rows were packed: rows of a crash, few
            rows = rows.join(F.broadcast(self.spark.createDataFrame(sorted(now.dead), schema("stream_epoch string, batch_id long, attempt_id string"))), ATTEMPT, "left_anti").select(rows.columns)
        return raw.unionByName(rows)

    def rejects(self, version: int | Snapshot | None = None) -> DataFrame:
        return self.read_files(self.snapshot(version).table("rejects"), REJECT_SCHEMA, "rejects")

    def state(self, version: int | Snapshot | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The current row of each key, of all tables, or of some buckets of keys."""
        files = self.snapshot(version).table("state")
        return self.read_files([f for f in files if buckets is None or f.bucket in buckets], STATE_SCHEMA, "state")

    def positions(self, epoch: str, batch_id: int, version: int | Snapshot | None = None, buckets: set[int] | None = None) -> DataFrame:
        """source_table, primary_key, _source_lsn: the highest position of each key in all batches but this one, from the
        kept state; a row that this very batch wrote last has its position before."""
        mine = (F.col("_stream_epoch") == epoch) & (F.col("_batch_id") == batch_id)
        rows = self.state(version, buckets).select(*KEY, F.when(mine, F.col("_prev_source_lsn")).otherwise(F.col("_source_lsn")).alias("_source_lsn"))
        return rows.where("_source_lsn is not null")

    def files_of_positions(self, behind: DataFrame, version: int | Snapshot | None = None) -> list[DataFile]:
        """Bronze files that may hold the positions ``source_lsn`` of some events."""
        found = sorted(r[0] for r in behind.select("source_lsn").distinct().limit(MANY_POSITIONS + 1).collect())  # bounded
        if not found:
            return []
        files = self.snapshot(version).table("bronze")
        if len(found) > MANY_POSITIONS:
            found = list(behind.agg(F.min("source_lsn"), F.max("source_lsn")).first())
            return [f for f in files if f.low <= found[1] and f.high >= found[0]]
        return [f for f in files if bisect.bisect_left(found, f.low) < bisect.bisect_right(found, f.high)]

    # ---- files --------------------------------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """path, length, modified: of every data file in the folder, committed or not, without reading its content."""
        if not self._exists(self.root):
            return self.spark.createDataFrame([], "path string, length long, modified timestamp")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.root)
        return found.select("path", "length", F.col("modificationTime").alias("modified"))

    def file_statistics(self, version: int | Snapshot | None = None) -> DataFrame:
        """kind, files, bytes: of the committed tables."""
        rows = [Row(kind=f.table, bytes=f.bytes) for f in self.snapshot(version).files.values()]
        return self.spark.createDataFrame(rows, "kind string, bytes long").groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
