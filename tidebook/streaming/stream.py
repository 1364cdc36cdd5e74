"""The streaming write path: decode, plan and commit micro-batches with the effect of exactly one delivery.

Every file of a batch is addressed by its attempt, and one commit makes all of them visible: a batch that is processed again,
after a crash or a replay of the source, leaves the same tables and one more attempt in the log.
"""

from __future__ import annotations

import datetime as dt
import json
import queue
import threading
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidebook.functions.scalars import text_or_base64, whole_json
from tidebook.operators.batchlog import batch_profile, fingerprint, freshness_sketch
from tidebook.operators.deadletter import dead_letter_events
from tidebook.operators.decode import decode, small_methods
from tidebook.operators.planner import APPLIED, DUPLICATE, LATENESS_MS, STALE, SUPERSEDED, next_watermark, plan_batch
from tidebook.operators.state import KEY, merge_state, state_rows
from tidebook.plans.contracts import Registry
from tidebook.plans.evolution import evolve
from tidebook.sources.commits import Conflict, Snapshot
from tidebook.sources.lake import BRONZE_SCHEMA, LOG_SCHEMA, REJECT_SCHEMA, STATE_SCHEMA, Lake, key_bucket

CONFLICTS = 5  # how often a batch is planned before a conflict is an error


class Pipeline:
    """Processes micro-batches of a change feed into a lake.

    ``contracts`` is called at the start of each batch; the registry it returns is used from there on, and the one before
    stays where it fails.  A batch that runs again uses the contracts of its first attempt where they are still known.
    """

    def __init__(self, lake: Lake, contracts, pii_key: bytes, epoch: str = "e1", lateness_ms: int = LATENESS_MS, publish: str | None = None):
        self.lake, self.contracts, self.pii_key, self.epoch, self.lateness_ms, self.publish = lake, contracts, pii_key, epoch, lateness_ms, publish
        self.registry: Registry = contracts()
        self.known = {self.registry.fingerprint(): self.registry}

    def _reload(self, batch_id: int, base: Snapshot) -> Registry:
        try:
            fresh = self.contracts()
            evolve(base.columns, fresh)
            self.known.setdefault(fresh.fingerprint(), fresh)
            self.registry = fresh
        except Exception:  # noqa: BLE001 - a broken contract file, or one that narrows stored columns, keeps the set before
            pass
        first = base.batches.get((self.epoch, batch_id))
        return self.known.get(first["contracts"], self.registry) if first else self.registry

    def _watermark(self, batch_id: int, base: Snapshot) -> int:
        return max([base.floor, *(v["watermark"] for (epoch, b), v in base.batches.items() if epoch != self.epoch or b < batch_id)])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; ``foreachBatch`` calls it with the batch's own session, which all frames here come from.

        What another writer commits meanwhile may change the plan, so the batch is planned and written anew then."""
        started, clock = dt.datetime.now(dt.timezone.utc), time.monotonic()
        registry = self._reload(batch_id, self.lake.snapshot())
        with small_methods(batch.sparkSession):
            decoded = decode(batch, registry, self.pii_key).withColumn("batch_id", F.lit(batch_id).cast("long")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with small_methods(batch.sparkSession):
                profile = batch_profile(decoded).first()
            if profile is None:
                return
            offsets = decoded.groupBy("kafka_topic", "kafka_partition").agg(F.min("kafka_offset").alias("a"), F.max("kafka_offset").alias("z")).collect()  # a row a partition
            row = {
                "pipeline": self.lake.pipeline, "stream_epoch": self.epoch, "batch_id": batch_id, "spark_app_id": self.lake.spark.sparkContext.applicationId, "started_at": started, "contracts": registry.fingerprint(),
                "input_rows": profile.input_rows, "valid_rows": profile.valid_rows, "dlq_rows": profile.dlq_rows, "tombstones": profile.tombstones, "max_source_ts_ms": profile.max_source_ts_ms,
                "kafka_offsets": json.dumps({f"{r.kafka_topic}:{r.kafka_partition}": [r.a, r.z] for r in sorted(offsets)}),
            }
            letters = profile.dlq_rows or not decoded.where("replay_of is not null").isEmpty()
            decode_ms = self._since(clock)
            for conflicts in range(CONFLICTS):
                try:
                    row = self._attempt(decoded, row | {"stage_ms": {"decode": decode_ms}, "commit_retries": conflicts}, bool(letters), clock)
                    break
                except Conflict:
                    if conflicts == CONFLICTS - 1:
                        raise
            if self.publish:
                publish_batches(self.lake.spark.createDataFrame([tuple(row[f.name] for f in LOG_SCHEMA)], LOG_SCHEMA), self.publish)
        finally:
            decoded.unpersist()

    @staticmethod
    def _since(mark: float) -> int:
        return int((time.monotonic() - mark) * 1000)

    def _attempt(self, decoded: DataFrame, row: dict, letters: bool, clock: float) -> dict:
        """Plan the batch against the newest snapshot, write its files, and commit them, with the columns that its contracts add."""
        registry = self.known.get(row["contracts"], self.registry)
        base, attempt, batch_id = self.lake.snapshot(), uuid.uuid4().hex, row["batch_id"]
        before = self._watermark(batch_id, base)
        row = row | {"attempt_id": attempt, "watermark_ms": before, "applied": 0, "superseded": 0, "stale": 0, "duplicates": 0, "late_rows": 0, "freshness_p50_ms": None, "freshness_p95_ms": None, "freshness_max_ms": None, "freshness_sketch": None, "contract_versions": ""}
        place = f"stream_epoch={self.epoch}/batch_id={batch_id}/attempt_id={attempt}"
        files, state_files, buckets = [], [], []
        if row["valid_rows"]:
            mark = time.monotonic()
            told, low, high, buckets = self._write_bronze(decoded, base, batch_id, attempt, before)
            files += self.lake.written_files("bronze", f"bronze/source_date=*/{place}", (self.epoch, batch_id, attempt), low, high)
            state_files = self.lake.written_files("state", f"state/attempt={attempt}/bucket=*", (self.epoch, batch_id, attempt))
            row |= told
            row["stage_ms"]["bronze"] = self._since(mark)
        if letters:
            mark = time.monotonic()
            rows = dead_letter_events(decoded).withColumns({"stream_epoch": F.lit(self.epoch), "attempt_id": F.lit(attempt)})
            self.lake.append("rejects", rows.select([F.col(f.name).cast(f.dataType) for f in REJECT_SCHEMA]), "stream_epoch", "batch_id", "attempt_id")
            files += self.lake.written_files("rejects", f"rejects/{place}", (self.epoch, batch_id, attempt))
            row["stage_ms"]["rejects"] = self._since(mark)
        row |= {"committed_at": dt.datetime.now(dt.timezone.utc), "duration_ms": self._since(clock), "added_data_files": len(files), "added_files_bytes": sum(f.bytes for f in files)}
        columns = evolve(base.columns, registry)
        self.lake.commit_batch(base, row, files + state_files, buckets, columns if columns != base.columns else None)
        return row

    def _write_bronze(self, decoded: DataFrame, base: Snapshot, batch_id: int, attempt: str, watermark: int) -> tuple[dict, int | None, int | None, list[int]]:
        """Bronze and state files of the batch; columns of its log row, the range of its positions, the buckets written."""
        lake, bucket = self.lake, key_bucket(self.lake.buckets)
        valid = decoded.where("status = 'valid'")
        touched = {r[0] for r in valid.select(bucket).distinct().collect()}  # a row a bucket
        silver = lake.positions(self.epoch, batch_id, base, touched)
        behind = valid.join(silver, list(KEY)).where(F.col("source_lsn") <= F.col("_source_lsn"))
        known = lake.bronze(base, lake.files_of_positions(behind, base)).select("event_id", "batch_id", "stream_epoch")
        planned = plan_batch(valid, known, silver, watermark, batch_id, self.epoch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            now = F.lit(dt.datetime.now(dt.timezone.utc))
            rows = planned.where(F.col("apply_outcome") != DUPLICATE).withColumns({
                "source_ts": F.timestamp_millis("source_ts_ms"), "debezium_ts": F.timestamp_millis("debezium_ts_ms"), "committed_at": now, "stream_epoch": F.lit(self.epoch),
                "attempt_id": F.lit(attempt), "source_date": F.to_date(F.timestamp_millis("source_ts_ms")),
            }).select([F.col(f.name).cast(f.dataType) for f in BRONZE_SCHEMA])
            lake.append("bronze", rows, "source_date", "stream_epoch", "batch_id", "attempt_id")
            buckets = self._write_state(rows.where(F.col("apply_outcome") == APPLIED), base, batch_id, attempt)
            fresh = F.col("apply_outcome") != DUPLICATE
            age = F.when(fresh, F.unix_millis(now) - F.col("source_ts_ms"))
            version = F.when(fresh, F.concat_ws("@", "contract_name", F.col("contract_version").cast("string")))
            lsn = F.when(fresh, F.col("source_lsn"))
            r = planned.agg(*[F.count_if(F.col("apply_outcome") == o).alias(o) for o in (APPLIED, SUPERSEDED, STALE, DUPLICATE)], F.count_if(F.coalesce("is_late", F.lit(False))).alias("late"), F.max(F.when(fresh, F.col("source_ts_ms"))).alias("newest"), F.percentile_approx(age, [0.5, 0.95]).alias("age"), F.max(age).alias("oldest"), F.array_join(F.array_sort(F.collect_set(version)), ",").alias("versions"), F.min(lsn).alias("low"), F.max(lsn).alias("high"), freshness_sketch(age).alias("sketch")).first()
        finally:
            planned.unpersist()
        middle, slow = r.age or (None, None)
        told = {"applied": r[APPLIED], "superseded": r[SUPERSEDED], "stale": r[STALE], "duplicates": r[DUPLICATE], "late_rows": r.late, "watermark_ms": next_watermark(watermark, r.newest, self.lateness_ms), "freshness_p50_ms": middle, "freshness_p95_ms": slow, "freshness_max_ms": r.oldest, "freshness_sketch": r.sketch, "contract_versions": r.versions}
        return told, r.low, r.high, buckets

    def _write_state(self, applied: DataFrame, base: Snapshot, batch_id: int, attempt: str) -> list[int]:
        """Write the touched buckets of the kept state anew; the others' files stay.  A batch that ran before and does now what
        it did then has nothing to write; where it does something else, its keys' rows are folded again without it."""
        lake, bucket = self.lake, key_bucket(self.lake.buckets)
        affected = None
        if earlier := lake.earlier_attempts(base, self.epoch, batch_id):
            mine = (F.col("stream_epoch") == self.epoch) & (F.col("batch_id") == batch_id)
            raw = [f for f in base.table("bronze") if f.attempt in earlier]
            old = lake.bronze(base, raw or None).where(mine & (F.col("apply_outcome") == APPLIED))
            effect = lambda rows: fingerprint(rows, *[F.col(c) for c in ("event_id", "before_json", "after_json", "previous_lsn")]).first()
            if effect(old) == effect(applied):
                return []
            affected = old.select(*KEY).union(applied.select(*KEY)).distinct()
        changed = applied.select(*KEY) if affected is None else affected
        buckets = sorted(r[0] for r in changed.select(bucket).distinct().collect())  # a row a bucket
        if not buckets:
            return []
        kept = lake.state(base, set(buckets))
        if affected is not None:
            history = lake.bronze(base).where(~mine).join(affected, list(KEY), "left_semi")
            kept = kept.join(affected, list(KEY), "left_anti").unionByName(state_rows(history))
        rows = merge_state(kept, applied).select([F.col(f.name).cast(f.dataType) for f in STATE_SCHEMA])
        rows.withColumn("bucket", bucket).repartition(len(buckets), "bucket").write.partitionBy("bucket").parquet(f"{lake.root}/state/attempt={attempt}")
        return buckets

    def start(self, feed: DataFrame, checkpoint: str, every: str | None = "5 seconds"):
        """Run on a streaming feed; ``every=None`` takes what is there and stops."""
        writer = feed.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def new_epoch(lake: Lake, checkpoint: str) -> str:
    """The epoch of the checkpoint; a new one where the checkpoint has no query metadata, so that batch ids never meet."""
    spark = lake.spark
    path = f"{checkpoint.rstrip('/')}/epoch"
    if lake._exists(f"{checkpoint.rstrip('/')}/metadata") and lake._exists(path):
        return spark.read.text(path).first().value
    epoch = uuid.uuid4().hex
    spark.range(1).select(F.lit(epoch).alias("value")).write.mode("overwrite").text(path)
    return epoch


def live_tap(feed: DataFrame) -> DataFrame:
    """Identifiers of any record, valid or not; works on a stream as on a table."""
    env = F.col("_env")
    get = lambda path, kind: F.try_variant_get(env, path, kind)
    return feed.withColumn("_env", whole_json(F.col("value").cast("string"))).select(
        "topic", "partition", "offset", "timestamp", text_or_base64(F.col("key")).alias("record_key"), get("$.op", "string").alias("op"), get("$.source.lsn", "bigint").alias("lsn"),
        get("$.source.ts_ms", "bigint").alias("ts_ms"), (F.col("value").isNotNull() & env.isNull()).alias("malformed"), F.col("value").isNull().alias("tombstone"),
    )


def publish_batches(log: DataFrame, path: str) -> bool:
    """Batch rows as key and JSON value, best effort: a failure never fails the batch."""
    try:
        log.select(F.concat_ws(":", "stream_epoch", F.col("batch_id").cast("string")).alias("key"), F.to_json(F.struct("*")).alias("value")).write.mode("append").json(path)
        return True
    except Exception:  # noqa: BLE001
        return False


def progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """batch, offsets, committed, in_flight: of a checkpoint's offset and commit files.  ``offsets`` has the JSON of each
    source; what is planned and not committed is in flight."""
    read = lambda name: spark.read.option("recursiveFileLookup", "true").text(f"{checkpoint.rstrip('/')}/{name}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"/(\d+)$", 1).try_cast("long").alias("batch"), "value")
    lines = F.split(F.trim("value"), "\n")  # version, metadata, then a line a source
    planned = read("offsets").where("batch is not null").select("batch", F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))).alias("offsets"))
    done = read("commits").where("batch is not null").select("batch", F.lit(True).alias("committed"))
    rows = planned.join(done, "batch", "left").withColumn("committed", F.coalesce("committed", F.lit(False)))
    return rows.withColumn("in_flight", ~F.col("committed"))


def checkpoint_offsets(rows: DataFrame) -> DataFrame:
    """kafka_topic, kafka_partition, end_offset: where the last committed batch of ``progress`` ends, for the lag."""
    last = rows.where("committed").agg(F.max_by("offsets", "batch").alias("offsets"))
    maps = last.select(F.explode("offsets").alias("j")).select(F.from_json("j", "map<string,map<string,bigint>>").alias("m"))
    topics = maps.select(F.explode("m").alias("kafka_topic", "ends"))
    return topics.select("kafka_topic", F.explode("ends").alias("partition", "end_offset")).select("kafka_topic", F.col("partition").cast("int").alias("kafka_partition"), "end_offset")


PROGRESS_SCHEMA = "query_id string, run_id string, event string, at timestamp, batch_id long, input_rows long, input_rows_per_second double, processed_rows_per_second double, duration_ms long"


class ProgressListener(StreamingQueryListener):
    """Keeps the last rates of each query, and hands every event to a queue that ``ProgressHistory`` writes from.

    A callback only looks at its event: writing there would hold up Spark's listener bus."""

    def __init__(self):
        self.rates: dict[str, dict] = {}
        self.events: queue.SimpleQueue = queue.SimpleQueue()

    def _tell(self, event, kind: str, p: dict) -> None:
        stamp = dt.datetime.now(dt.timezone.utc)
        took = (p.get("durationMs") or {}).get("triggerExecution")
        self.events.put((str(event.id if not p else p["id"]), str(event.runId if not p else p["runId"]), kind, stamp, p.get("batchId"), p.get("numInputRows"), p.get("inputRowsPerSecond"), p.get("processedRowsPerSecond"), took))

    def onQueryStarted(self, event):  # noqa: N802 - Spark's names
        self.rates[str(event.id)] = {"active": True}
        self._tell(event, "started", {})

    def onQueryProgress(self, event):  # noqa: N802
        p = json.loads(event.progress.json)
        self.rates[str(event.progress.id)] = {"active": True, "input_rows_per_second": p.get("inputRowsPerSecond"), "processed_rows_per_second": p.get("processedRowsPerSecond"), "batch_id": p.get("batchId")}
        self._tell(event, "progress", p)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.rates.setdefault(str(event.id), {})["active"] = False
        self._tell(event, "terminated", {})

    def table(self, spark: SparkSession) -> DataFrame:
        """query_id, active, input_rows_per_second, processed_rows_per_second, batch_id: a row a query."""
        names = ("active", "input_rows_per_second", "processed_rows_per_second", "batch_id")
        return spark.createDataFrame([(k, *(v.get(n) for n in names)) for k, v in sorted(self.rates.items())], "query_id string, active boolean, input_rows_per_second double, processed_rows_per_second double, batch_id long")


class ProgressHistory:
    """Appends what a listener heard to the table ``progress`` of a lake, every few seconds and once more at the end, from a
    thread of its own; a failed write is tried again with the next events."""

    def __init__(self, lake: Lake, listener: ProgressListener, every_seconds: float = 30.0):
        self.lake, self.listener, self.every = lake, listener, every_seconds
        self.waiting: list[tuple] = []
        self.ended = threading.Event()
        self.writer = threading.Thread(target=self._run, daemon=True)
        self.writer.start()

    def flush(self) -> int:
        """Write the events that came; how many."""
        while not self.listener.events.empty():
            self.waiting.append(self.listener.events.get())
        rows = list(self.waiting)
        if rows:
            self.lake.append("progress", self.lake.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1))
            del self.waiting[: len(rows)]
        return len(rows)

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            try:
                self.flush()
            except Exception:  # noqa: BLE001 - the events stay, and are written with the next ones
                pass

    def close(self) -> None:
        self.ended.set()
        self.writer.join()
        self.flush()

    def table(self) -> DataFrame:
        return self.lake.spark.read.schema(PROGRESS_SCHEMA).parquet(f"{self.lake.root}/progress")
