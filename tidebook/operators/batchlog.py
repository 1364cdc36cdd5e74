"""Profile of micro-batches: counts, offset ranges, outcomes, freshness, and the log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import seconds_between
from tidebook.operators.percentiles import percentiles

OUTCOMES = ("applied", "superseded", "stale", "duplicate")


def batch_profile(decoded: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Status counts, oldest and newest source time and number of keys, by batch: one conditional aggregation."""
    valid = F.col("status") == "valid"
    return decoded.groupBy(*by).agg(
        F.count("*").alias("input_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.count_if(F.col("status") == "rejected").alias("dlq_rows"),
        F.count_if(F.col("status") == "tombstone").alias("tombstones"),
        F.min(F.when(valid, F.col("source_ts_ms"))).alias("min_source_ts_ms"),
        F.max(F.when(valid, F.col("source_ts_ms"))).alias("max_source_ts_ms"),
        F.count_distinct(F.when(valid, F.col("primary_key"))).alias("keys_seen"),
    )


def offset_ranges(rows: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    return rows.groupBy(*by, "kafka_topic", "kafka_partition").agg(F.min("kafka_offset").alias("from_offset"), F.max("kafka_offset").alias("to_offset"), F.count("*").alias("records"))


def end_offsets(rows: DataFrame) -> DataFrame:
    """The offset after the last one, of each topic and partition."""
    return rows.groupBy("kafka_topic", "kafka_partition").agg((F.max("kafka_offset") + 1).alias("end_offset"))


def lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Total consumer lag: what lies between the committed and the end offsets; one row."""
    joined = ends.join(committed.withColumnRenamed("end_offset", "committed_offset"), ["kafka_topic", "kafka_partition"], "left")
    gap = F.greatest(F.col("end_offset") - F.coalesce("committed_offset", F.lit(0)), F.lit(0))
    return joined.agg(F.coalesce(F.sum(gap), F.lit(0)).alias("total_lag"), F.count("*").alias("partitions"))


def outcome_counts(planned: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One row a batch: how many events had each outcome, and how many were late."""
    counts = [F.count_if(F.col("apply_outcome") == o).alias(o) for o in OUTCOMES]
    return planned.groupBy(*by).agg(*counts, F.count_if(F.coalesce("is_late", F.lit(False))).alias("late_rows"))


def _beside(found: DataFrame, rest: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Columns of two aggregations of the same groups; without groups both are one row."""
    if by:
        return rest.join(found, list(by), "left")
    return rest.join(found, F.lit(True), "left")


def freshness(rows: DataFrame, committed: Column, source: Column, *by: str, exact: bool = False) -> DataFrame:
    """p50, p95 and maximum of seconds from source to commit; exact percentiles on request, else from a bounded sketch."""
    seconds = seconds_between(committed, source)
    rest = rows.groupBy(*by).agg(F.max(seconds).alias("longest"), F.count("*").alias("events"))
    return _beside(percentiles(rows, seconds, {"p50": 0.5, "p95": 0.95}, *by, exact=exact), rest, by).select(*by, "p50", "p95", "longest", "events")


SKETCH_SIZE = 400  # a quantile's rank is within about one percent


def freshness_sketch(milliseconds: Column) -> Column:
    """A mergeable quantile sketch of a batch's ages, as text; a few kilobytes however many events it has seen."""
    return F.base64(F.kll_sketch_agg_bigint(milliseconds, F.lit(SKETCH_SIZE)))


def logged_freshness(log: DataFrame, *by: Column) -> DataFrame:
    """p50 and p95 of seconds from source to commit and the number of events, by groups of batches, from the sketches in the
    batch log: neither bronze nor any event is read.  ``freshness`` has the exact values."""
    merged = log.where("freshness_sketch is not null").groupBy(*by).agg(F.kll_merge_agg_bigint(F.unbase64("freshness_sketch")).alias("k"), F.max("freshness_max_ms").alias("top"))
    at = lambda q: (F.kll_sketch_get_quantile_bigint("k", F.lit(q)) / 1000).alias(f"p{round(100 * q)}")
    names = [c for c in merged.columns if c not in ("k", "top")]
    return merged.select(*names, at(0.5), at(0.95), (F.col("top") / 1000).alias("longest"), F.kll_sketch_get_n_bigint("k").alias("events"))


def statistics(rows: DataFrame, value: Column, *by: str, exact: bool = False) -> DataFrame:
    """Percentiles (from a bounded sketch, or exact and linear between values), mean, sample deviation (0 for one value),
    minimum, maximum and count."""
    names = {f"p{round(q * 100)}": q for q in (0.5, 0.95, 0.99)}
    rest = rows.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
        F.min(value).alias("smallest"),
        F.max(value).alias("largest"),
        F.count(value).alias("samples"),
    )
    return _beside(percentiles(rows, value, names, *by, exact=exact), rest, by).select(*by, *names, "mean", "stddev", "smallest", "largest", "samples")


def latest_attempts(log: DataFrame) -> DataFrame:
    """The batch log with one row a batch: the last attempt's columns, and the number of attempts."""
    batch = Window.partitionBy("pipeline", "stream_epoch", "batch_id")
    rows = log.withColumns({"attempts": F.count("*").over(batch), "_last": F.row_number().over(batch.orderBy(F.col("started_at").desc(), F.col("attempt_id").desc()))})
    return rows.where("_last = 1").drop("_last")


def newest(rows: DataFrame, by: str, n: int = 50, *ties: str) -> DataFrame:
    """The n newest rows: a top-n, not a sort of all."""
    return rows.orderBy(F.col(by).desc(), *ties).limit(n)


def totals(log: DataFrame, since: Column) -> DataFrame:
    """Sums of the batch log from a time on; one row."""
    names = ("input_rows", "valid_rows", "dlq_rows", "duplicates", "applied", "superseded", "stale", "late_rows", "commit_retries")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names if c in log.columns]
    return log.where(F.col("committed_at") >= since).agg(*sums, F.count("*").alias("batches"), F.max("committed_at").alias("last_commit"))


def fingerprint(rows: DataFrame, *identity: Column) -> DataFrame:
    """Order-free content check: rows, exclusive-or and sum of a 60-bit digest of each row's identity text."""
    digest = F.conv(F.substr(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in identity])), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
    return rows.select(digest.alias("d")).agg(F.count("*").alias("row_count"), F.coalesce(F.bit_xor("d"), F.lit(0)).alias("xor_digest"), F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_digest"))
