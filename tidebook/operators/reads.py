"""Analytical reads over bronze events, current rows, dead letters and the batch log.

Every function takes an explicit time where it looks back, so that its result can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.percentiles import percentiles
from tidebook.functions.scalars import percentage, seconds_between
from tidebook.operators.batchlog import newest

STALE_SECONDS, RAW_LENGTH = 45, 2000
STAGES = ("source", "capture", "feed", "stream", "commit", "lake", "reader")


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def events(bronze: DataFrame, as_of: Column, table: str | None = None, op: str | None = None, outcome: str | None = None, key: str | None = None, minutes: int = 60, limit: int = 100) -> DataFrame:
    """Newest committed events of the last minutes, images parsed."""
    rows = bronze.where(F.col("committed_at") >= minutes_before(as_of, minutes))
    for column, value in (("source_table", table), ("op", op), ("apply_outcome", outcome), ("primary_key", key)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.orderBy(F.col("committed_at").desc(), F.col("source_lsn").desc()).limit(limit)
    return rows.withColumns({f"{side}_image": F.try_parse_json(f"{side}_json") for side in ("before", "after") if f"{side}_json" in rows.columns})


def recent_batches(log: DataFrame, limit: int = 50) -> DataFrame:
    return newest(log, "committed_at", limit, "batch_id")


def trace_stages(keys: DataFrame, source: DataFrame, bronze: DataFrame, letters: DataFrame, log: DataFrame, silver: DataFrame) -> DataFrame:
    """How far the change of each key came: a row for each key and stage, from evidence only.

    ``keys``: source_table, primary_key.  ``source``: keys that exist at the source.  ``letters``: with primary_key.
    """
    on = ["source_table", "primary_key"]
    flag = lambda df, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    committed = bronze.join(log.select("stream_epoch", "batch_id").distinct(), ["stream_epoch", "batch_id"], "left_semi")
    seen = keys.select(*on).distinct()
    for df, name in ((source, "at_source"), (bronze, "captured"), (letters, "rejected"), (committed, "committed"), (silver, "in_lake")):
        seen = seen.join(flag(df, name), on, "left")
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    arrived = t("captured") | t("rejected")
    state = {
        "source": F.when(t("at_source") | arrived, "done").otherwise("pending"),
        "capture": F.when(arrived, "done").otherwise("pending"),
        "feed": F.when(arrived, "done").otherwise("pending"),
        "stream": F.when(t("captured"), "done").when(t("rejected"), "failed").otherwise("pending"),
        "commit": F.when(t("committed"), "done").when(t("rejected") & ~t("captured"), "skipped").otherwise("pending"),
        "lake": F.when(t("in_lake"), "done").when(t("rejected") & ~t("captured"), "skipped").otherwise("pending"),
        "reader": F.when(t("in_lake") & t("committed"), "done").when(t("rejected") & ~t("captured"), "skipped").otherwise("pending"),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), state[s].alias("state")) for i, s in enumerate(STAGES)])
    return seen.select(*on, F.explode(rows).alias("r")).select(*on, "r.*")


def trace_evidence(keys: DataFrame, bronze: DataFrame, letters: DataFrame, silver: DataFrame) -> DataFrame:
    """What the stages of a trace rest on: a row for each event of a key, each of its rejects, and its current state.

    evidence is event, reject or state; ``result`` is an event's operation and outcome, a reject's code and status, or live or
    deleted; ``seconds`` is the time from the source to the commit.  ``letters``: with source_table and primary_key.
    """
    on = ["source_table", "primary_key"]
    seen = keys.select(*on).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    place = ["kafka_partition", "kafka_offset"]
    pair = lambda a, b: F.concat_ws(" ", F.col(a), F.col(b))
    fresh = seconds_between(F.col("committed_at"), F.col("source_ts"))
    parts = [
        bronze.select(*on, F.lit("event").alias("evidence"), F.col("committed_at").alias("at"), "source_lsn", *place, pair("op", "apply_outcome").alias("result"), fresh.alias("seconds")),
        letters.select(*on, F.lit("reject").alias("evidence"), F.col("last_seen_at").alias("at"), none("long").alias("source_lsn"), *place, pair("error_code", "status").alias("result"), none("double").alias("seconds")),
        silver.select(*on, F.lit("state").alias("evidence"), F.col("_ingested_at").alias("at"), F.col("_source_lsn").alias("source_lsn"), none("int").alias(place[0]), none("long").alias(place[1]), F.when(F.col("is_deleted"), "deleted").otherwise("live").alias("result"), none("double").alias("seconds")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(seen, on, "left_semi")


def rejects_of_key(letters: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Newest rejects whose raw key contains the text."""
    return newest(letters.where(F.instr(F.coalesce("raw_key", F.lit("")), text) > 0), "last_seen_at", limit, "dlq_id")


def overview(log: DataFrame, bronze: DataFrame, as_of: Column, minutes: int = 15, exact: bool = False) -> DataFrame:
    """One row: freshness of applied events, reject rate, duplicates, applied, batches and last commit of a window."""
    since = minutes_before(as_of, minutes)
    batches = log.where(F.col("committed_at") >= since).agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"),
        percentage(F.coalesce(F.sum("dlq_rows"), F.lit(0)), F.coalesce(F.sum("input_rows"), F.lit(0))).alias("reject_percent"), F.max("committed_at").alias("last_commit"), F.lit(1).alias("one"),
    )
    seconds = seconds_between(F.col("committed_at"), F.col("source_ts"))
    fresh = bronze.where((F.col("committed_at") >= since) & (F.col("apply_outcome") == "applied"))
    fresh = percentiles(fresh, seconds, {"p50": 0.5, "p95": 0.95}, exact=exact).agg(F.max("p50").alias("p50"), F.max("p95").alias("p95"), F.lit(1).alias("one"))
    return batches.join(fresh, "one").drop("one")


def sla_status(fresh: DataFrame, targets: DataFrame) -> DataFrame:
    """met, breached or no_data for each contract.  ``fresh``: dataset, p95; ``targets``: dataset, p95_seconds."""
    rows = targets.join(fresh.select("dataset", "p95"), "dataset", "left")
    return rows.withColumn("status", F.when(F.col("p95").isNull(), "no_data").when(F.col("p95") <= F.col("p95_seconds"), "met").otherwise("breached"))


def is_stale(at: Column, as_of: Column, seconds: int = STALE_SECONDS) -> Column:
    return at.isNull() | (seconds_between(as_of, at) > seconds)


def rejects(letters: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    rows = letters if status is None else letters.where(F.col("status") == status)
    return newest(rows.withColumn("raw_value", F.substr("raw_value", F.lit(1), F.lit(RAW_LENGTH))), "last_seen_at", limit, "dlq_id")


def versions_seen(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("contract_name", "contract_version").agg(F.count("*").alias("events"), F.min("source_ts_ms").alias("first_seen_ms"), F.max("source_ts_ms").alias("last_seen_ms"))


def drift_by_field(bronze: DataFrame) -> DataFrame:
    rows = bronze.select("contract_name", "source_ts_ms", F.explode("drift_fields").alias("field"))
    return rows.groupBy("contract_name", "field").agg(F.count("*").alias("events"), F.max("source_ts_ms").alias("last_seen_ms"))


def rejects_by_code(letters: DataFrame) -> DataFrame:
    return letters.where(F.col("status") == "open").groupBy("error_code").agg(F.count("*").alias("open_records"))


def dataset_statistics(tables: dict[str, DataFrame], committed: str = "_ingested_at") -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("row_count"), F.max(committed).alias("last_commit")).withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def revenue(rows: DataFrame, *by: str, amount: str = "amount") -> DataFrame:
    """Orders and revenue of live rows."""
    return rows.where(~F.col("is_deleted")).groupBy(*by).agg(F.count("*").alias("order_count"), F.sum(amount).alias("revenue"))


def image_diff(event: DataFrame) -> DataFrame:
    """A row for each field that an event's images don't share: event_id, field, before, after."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = event.select("event_id", as_map("before_json").alias("b"), as_map("after_json").alias("a"))
    fields = F.explode(F.array_distinct(F.concat(F.map_keys("b"), F.map_keys("a"))))
    rows = rows.select("event_id", "b", "a", fields.alias("field"))
    rows = rows.select("event_id", "field", F.try_element_at("b", "field").alias("before"), F.try_element_at("a", "field").alias("after"))
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def key_history(bronze: DataFrame, keys: DataFrame) -> DataFrame:
    """All events of the keys, ordered by position."""
    return bronze.join(keys, ["source_table", "primary_key"], "left_semi").orderBy("source_table", "primary_key", "source_lsn", "kafka_offset")


def newest_live(rows: DataFrame, limit: int = 100, at: str = "_ingested_at") -> DataFrame:
    return newest(rows.where(~F.col("is_deleted")), at, limit, "primary_key")


def newest_events(bronze: DataFrame, topic: str, limit: int = 100) -> DataFrame:
    """Newest events of a topic that nobody injected."""
    rows = bronze.where((F.col("kafka_topic") == topic) & F.col("injection_id").isNull())
    return rows.orderBy(F.col("committed_at").desc(), F.col("kafka_offset").desc(), "kafka_partition").limit(limit)
