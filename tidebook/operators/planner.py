"""Plan what each change event does: duplicate, stale, superseded or applied, and whether it is late.

``plan_history`` gives the outcomes of all batches of a history in one job, from windows alone; ``plan_batch`` plans one
micro-batch against what was committed before it.  Both see the same rules:

* an event whose id was seen before, in this batch at a smaller (topic, partition, offset) or in an earlier batch, is a duplicate;
* a key's event whose log sequence number isn't above that of the key's earlier batches is stale;
* of the others, all but the batch's last of a key are superseded, and that one is applied;
* an event older than the watermark of the batches before is late, which is reported and drops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DUPLICATE, STALE, SUPERSEDED, APPLIED = "duplicate", "stale", "superseded", "applied"
LATENESS_MS = 300_000
_ARRIVAL = ("kafka_topic", "kafka_partition", "kafka_offset")
_KEY = ("source_table", "primary_key")
_ONE_DAY_MS = 86_400_000


def _last_first():
    return [F.col("source_lsn").desc(), F.col("kafka_offset").desc(), F.col("kafka_topic"), F.col("kafka_partition")]


def watermarks(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """batch_id and the watermark that holds while it runs; one row a batch, so the window is over batches, not events."""
    per_batch = events.groupBy("batch_id").agg(F.max("source_ts_ms").alias("newest"))
    before = F.max("newest").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    return per_batch.select("batch_id", F.greatest(F.lit(0), F.coalesce(before - lateness_ms, F.lit(0))).alias("watermark_ms"))


def mark_repeats(events: DataFrame) -> DataFrame:
    """Add ``arrival``: 1 for the first delivery of an event id, by batch and Kafka place."""
    return events.withColumn("arrival", F.row_number().over(Window.partitionBy("event_id").orderBy("batch_id", *_ARRIVAL)))


def plan_history(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """``events`` with ``apply_outcome`` and ``is_late`` (null for duplicates).

    Needs event_id, source_table, primary_key, source_lsn, source_ts_ms, batch_id and the Kafka place.  ``previous_lsn`` is
    added: the key's highest position of the batches before, which is that of its applied event before.  The events are
    shuffled by id, and by key and batch; a key's batches and the watermarks are a row each and are joined.
    """
    marked = mark_repeats(events)
    first = F.when(F.col("arrival") == 1, F.col("source_ts_ms"))
    marks = watermarks(marked.select("batch_id", first.alias("source_ts_ms")), lateness_ms)
    # by key and batch first: the window by key then sees a row a batch, and a hot key's events meet it in a join
    place = F.struct((-F.col("source_lsn")).alias("a"), (-F.col("kafka_offset")).alias("b"), F.col("kafka_topic").alias("c"), F.col("kafka_partition").alias("d"))
    tops = marked.where("arrival = 1").groupBy(*_KEY, "batch_id").agg(F.max("source_lsn").alias("_lsn"), F.min(place).alias("_top"))
    tops = tops.withColumn("_base", F.max("_lsn").over(Window.partitionBy(*_KEY).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)))
    planned = marked.join(tops, [*_KEY, "batch_id"], "left").withColumn("_rank", F.when(place == F.col("_top"), 1).otherwise(2)).join(marks, "batch_id")
    return _outcomes(planned, F.col("arrival") > 1).withColumnRenamed("_base", "previous_lsn").drop("arrival", "_lsn", "_top", "_rank", "watermark_ms")


def plan_keys(events: DataFrame) -> DataFrame:
    """``plan_history`` without lateness, for ids that belong to one key each, as those made of a key and a position do: every
    window is by key, so rows that lie by key are shuffled no more, neither here nor by a fold.  A key's events meet in one task.
    """
    first = F.col("arrival") == 1
    lsn = F.when(first, F.col("source_lsn"))
    marked = events.withColumn("arrival", F.row_number().over(Window.partitionBy(*_KEY, "event_id").orderBy("batch_id", *_ARRIVAL)))
    # repeats come last in their batch; the next window finds the rows in its order already
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(*_KEY, "batch_id").orderBy(~first, *_last_first())))
    planned = ranked.withColumn("_base", F.max(lsn).over(Window.partitionBy(*_KEY).orderBy("batch_id").rangeBetween(Window.unboundedPreceding, -1)))
    return planned.withColumn("apply_outcome", _outcome(~first)).withColumnRenamed("_base", "previous_lsn").drop("arrival", "_rank")


def _outcome(repeated) -> Column:
    return F.when(repeated, DUPLICATE).when(F.col("source_lsn") <= F.col("_base"), STALE).when(F.col("_rank") > 1, SUPERSEDED).otherwise(APPLIED)


def _outcomes(planned: DataFrame, repeated) -> DataFrame:
    return planned.withColumns({"apply_outcome": _outcome(repeated), "is_late": F.when(~repeated, F.col("source_ts_ms") < F.col("watermark_ms"))})


def plan_batch(batch: DataFrame, bronze: DataFrame, silver_lsn: DataFrame, watermark_ms: int, batch_id: int, stream_epoch: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Plan one micro-batch of valid events.

    ``bronze``: committed events (event_id, batch_id, stream_epoch, source_date); this batch's own earlier attempts do not
    count.  The look-up reads the days of [from_ms, to_ms] with a day on either side, so that a redelivery whose source time
    moved is still found.  ``silver_lsn``: source_table, primary_key, _source_lsn from the batches before.
    """
    known = bronze.where(~((F.col("stream_epoch") == stream_epoch) & (F.col("batch_id") == batch_id)))
    if from_ms is not None and "source_date" in bronze.columns:
        low, high = (F.to_date(F.timestamp_millis(F.lit(ms).cast("long"))) for ms in (from_ms - _ONE_DAY_MS, to_ms + _ONE_DAY_MS))
        known = known.where(F.col("source_date").between(low, high))
    known = known.groupBy("event_id").agg(F.lit(True).alias("_known"))
    marked = batch.withColumn("_arrival", F.row_number().over(Window.partitionBy("event_id").orderBy(*_ARRIVAL)))
    marked = marked.join(known, "event_id", "left").withColumn("_repeat", (F.col("_arrival") > 1) | F.coalesce("_known", F.lit(False)))
    marked = marked.withColumn("_lsn", F.when(~F.col("_repeat"), F.col("source_lsn")))
    ranks = Window.partitionBy(*_KEY).orderBy(F.col("_lsn").desc_nulls_last(), *_last_first()[1:])
    base = silver_lsn.select(*_KEY, F.col("_source_lsn").alias("_base"))
    planned = marked.withColumn("_rank", F.row_number().over(ranks)).join(base, list(_KEY), "left").withColumn("watermark_ms", F.lit(watermark_ms).cast("long"))
    return _outcomes(planned, F.col("_repeat")).withColumnRenamed("_base", "previous_lsn").drop("_arrival", "_known", "_repeat", "_lsn", "_rank", "watermark_ms")


def next_watermark(before_ms: int, newest_ms: int | None, lateness_ms: int = LATENESS_MS) -> int:
    return before_ms if newest_ms is None else max(before_ms, newest_ms - lateness_ms)
