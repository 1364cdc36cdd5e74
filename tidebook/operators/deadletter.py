"""Dead letters: an append-only log of rejects and replays, folded to the state of each reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import PIPE, bytes_of, part, position, whole_json
from tidebook.operators.decode import ORIGINAL_TOPIC, REPLAY_OF, decoded_table
from tidebook.plans.contracts import Registry

OPEN, REPLAYED = "open", "replayed"
REPLAY_TOPIC, REPLAY_LIMIT = "cdc.replay", 50


def dead_letter_id() -> Column:
    """The id of the record that was rejected first: named by a replay's header, else a digest of the Kafka place."""
    return F.coalesce(F.col("replay_of"), F.sha2(F.concat_ws(PIPE, "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string")), 256))


def logged() -> Column:
    """Whether a decoded row belongs into the log: rejects, and replays that are valid."""
    return (F.col("status") == "rejected") | (F.col("replay_of").isNotNull() & (F.col("status") == "valid"))


# Decoded columns that the log and the letters read.
LOGGED = (
    "kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts", "source_topic", "replay_of", "injection_id", "status", "error_code", "error_detail",
    "violations", "raw_key", "raw_value", "contract_name",
)


def dead_letter_events(decoded: DataFrame) -> DataFrame:
    """Rejects, and valid or again rejected replays, as log rows; of several replays of one id in a batch the last stays."""
    rejected = F.col("status") == "rejected"
    rows = decoded.where(logged())
    rows = rows.withColumns({
        "dlq_id": dead_letter_id(),
        "is_replay": F.col("replay_of").isNotNull(),
        "replay_position": F.when(F.col("replay_of").isNotNull(), position(F.col("kafka_partition"), F.col("kafka_offset"))),
        "outcome": F.when(rejected, OPEN).otherwise(REPLAYED),
    })
    last = Window.partitionBy("dlq_id", "batch_id").orderBy(F.col("replay_position").desc_nulls_last(), "kafka_topic", "kafka_partition", "kafka_offset")
    return rows.withColumn("_rank", F.row_number().over(last)).where(~F.col("is_replay") | (F.col("_rank") == 1)).drop("_rank")


def dead_letters(log: DataFrame) -> DataFrame:
    """State of each reject: the first record's columns, then what its replays did to it.

    A replay counts only if its position is above all earlier ones; a replay of an id that was never rejected is ignored; a
    redelivery of the reject does nothing.
    """
    mine = Window.partitionBy("dlq_id").orderBy("batch_id", "replay_position")
    before = F.max("replay_position").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("_counts", F.col("is_replay") & (before.isNull() | (F.col("replay_position") > before)))
    first = F.struct("batch_id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts", "source_topic", "contract_name", "raw_key", "raw_value", "injection_id")
    last = F.max_by(F.struct("outcome", "batch_id", "kafka_ts"), F.when(F.col("_counts"), F.col("replay_position")))
    error = F.struct("error_code", "error_detail", "violations")
    folded = rows.groupBy("dlq_id").agg(
        F.min(F.when(~F.col("is_replay"), first)).alias("f"),
        last.alias("l"),
        F.count_if(F.col("_counts")).alias("replay_attempts"),
        F.max(F.when(F.col("_counts"), F.col("replay_position"))).alias("last_replay_position"),
        F.max_by(error, F.when(F.col("outcome") == OPEN, F.struct(F.col("batch_id"), F.coalesce("replay_position", F.lit(""))))).alias("e"),
        F.max("kafka_ts").alias("last_seen_at"),
    )
    folded = folded.where(F.col("f").isNotNull())
    status = F.when(F.col("replay_attempts") > 0, F.col("l.outcome")).otherwise(OPEN)
    done = status == REPLAYED
    return folded.select(
        "dlq_id", F.col("f.kafka_ts").alias("first_seen_at"), "last_seen_at", "f.kafka_topic", "f.kafka_partition", "f.kafka_offset", "f.kafka_ts", "f.source_topic",
        "f.contract_name", "e.error_code", "e.error_detail", "e.violations", "f.raw_key", "f.raw_value", "f.injection_id", status.alias("status"), "replay_attempts",
        "last_replay_position", F.when(done, F.col("l.kafka_ts")).alias("resolved_at"), F.when(done, F.col("l.batch_id")).alias("resolved_batch_id"), F.col("f.batch_id").alias("batch_id"),
    )


def replay_records(letters: DataFrame, ids: list[str] | None = None, error_code: str | None = None, limit: int | None = REPLAY_LIMIT, topic: str = REPLAY_TOPIC) -> DataFrame:
    """Kafka-shaped records that send open rejects through the normal path again, oldest first, with their origin in headers.

    Without a limit every open reject is sent, in no order.
    """
    rows = letters.where(F.col("status") == OPEN)
    if ids is not None:
        rows = rows.where(F.col("dlq_id").isin(ids if limit is None else ids[:limit]))
    if error_code is not None:
        rows = rows.where(F.col("error_code") == error_code)
    if limit is not None:
        rows = rows.orderBy("first_seen_at", "dlq_id").limit(limit)
    head = lambda key, value: F.struct(F.lit(key).alias("key"), F.encode(value, "UTF-8").alias("value"))
    return rows.select(
        bytes_of(F.col("raw_key")).alias("key"),
        bytes_of(F.col("raw_value")).alias("value"),
        F.lit(topic).alias("topic"),
        F.array(head(ORIGINAL_TOPIC, F.col("source_topic")), head(REPLAY_OF, F.col("dlq_id"))).alias("headers"),
    )


def dry_run(records: DataFrame, registry: Registry, pii_key: bytes) -> DataFrame:
    """What replay records would decode to, with nothing published or logged: dlq_id, status, error_code, violations, contract_version."""
    feed = records.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long"), "timestamp": F.lit(None).cast("timestamp")})
    rows = decoded_table(feed, registry, pii_key, "dry-run", ("replay_of", "status", "error_code", "violations", "contract_version"))
    return rows.withColumnRenamed("replay_of", "dlq_id")


def reject_impact(letters: DataFrame, candidate: Registry, pii_key: bytes) -> DataFrame:
    """What candidate contracts would make of all open rejects: rows by (error_code now, error_code then), and how many of
    them would be accepted.  An id that several letters have counts once for each."""
    then = dry_run(replay_records(letters, limit=None), candidate, pii_key).select("dlq_id", F.col("status").alias("_then"), F.col("error_code").alias("then_code"))
    rows = letters.where(F.col("status") == OPEN).select("dlq_id", "error_code").join(then, "dlq_id")
    return rows.groupBy("error_code", "then_code").agg(F.count("*").alias("records"), F.count_if(F.col("_then") == "valid").alias("accepted"))


def with_key(letters: DataFrame, registry: Registry) -> DataFrame:
    """Letters with the source_table and primary_key that their raw key names: rejects are found by key though their image may
    be unreadable.  Both are null where the topic is unknown, the key isn't a JSON object or lacks a key field."""
    doc = whole_json(F.col("raw_key"))
    rows = letters.withColumn("_doc", F.when(part(doc, "payload").isNotNull() & part(doc, "schema").isNotNull(), part(doc, "payload")).otherwise(doc))
    table = key = None
    for name in registry.names:
        contract = registry.current(name)
        fields = [F.try_variant_get("_doc", f"$.{k}", "string") for k in contract.key]
        whole = F.when(F.concat(*fields).isNotNull(), F.concat_ws(PIPE, *fields))
        mine = F.col("contract_name") == name
        table = F.when(mine, F.lit(contract.table)) if table is None else table.when(mine, F.lit(contract.table))
        key = F.when(mine, whole) if key is None else key.when(mine, whole)
    rows = rows.withColumns({"source_table": table, "primary_key": key}).drop("_doc")
    return rows.withColumn("source_table", F.when(F.col("primary_key").isNotNull(), F.col("source_table")))
