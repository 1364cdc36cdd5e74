"""Statistics of benchmark runs over raw samples.

A run document has iterations with counts, first source and last commit time, and raw latencies (``latency_ms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.scalars import ratio
from tidebook.operators.batchlog import statistics

SCHEMA_VERSION = 1
REQUIRED = ("schema_version", "run_id", "created_at", "iterations")


def run_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every run document below a path with what is wrong with it: path, text and ``faults`` (fields that are missing or
    null, an unknown version, text that is no JSON object); good documents have none."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    doc = F.try_parse_json("text")
    get = lambda field, kind: F.try_variant_get(doc, f"$.{field}", kind)
    lacks = [F.when(get(c, "string").isNull(), F.lit(f"{c} is missing")) for c in REQUIRED]
    odd = F.when(get("schema_version", "string").isNotNull() & ~F.coalesce(get("schema_version", "int") == SCHEMA_VERSION, F.lit(False)), F.concat(F.lit("schema_version is "), get("schema_version", "string")))
    found = F.when(doc.isNull() | ~F.schema_of_variant(doc).like("OBJECT%"), F.array(F.lit("no JSON object"))).otherwise(F.array_compact(F.array(*lacks, odd)))
    return docs.withColumn("faults", found)


def read_runs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Run documents with all required fields and a known version.  Others are left out, or, on request, an error that names
    each file and its faulty fields."""
    if strict:
        bad = run_documents(spark, path).where(F.size("faults") > 0).select("path", F.array_join("faults", ", ").alias("faults")).orderBy("path").limit(20).collect()
        if bad:
            raise ValueError("; ".join(f"{r.path}: {r.faults}" for r in bad))
    rows = spark.read.option("multiLine", True).json(path)
    if any(c not in rows.columns for c in REQUIRED):
        return rows.where(F.lit(False))
    ok = F.col("schema_version") == SCHEMA_VERSION
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok)


def iteration_summary(iterations: DataFrame) -> DataFrame:
    """Throughput, loss, duplicate and error rates of each iteration."""
    seconds = F.greatest((F.col("last_commit_ms") - F.col("first_source_ms")) / 1000.0, F.lit(1e-9))
    expected, observed = F.col("events_expected"), F.col("events_observed")
    return iterations.withColumns({
        "throughput_eps": observed / seconds,
        "loss_rate": ratio(F.greatest(expected - observed, F.lit(0)), F.greatest(expected, F.lit(1))),
        "duplicate_rate": ratio(F.col("duplicates_observed"), F.greatest(observed, F.lit(1))),
        "error_rate": ratio(F.col("dlq_events"), F.greatest(expected, F.lit(1))),
    })


def pooled_latency(samples: DataFrame, value: str = "latency_ms", *by: str, exact: bool = False) -> DataFrame:
    return statistics(samples, F.col(value).cast("double"), *by, exact=exact)


def limit_table(spark, limits: dict[str, float]) -> DataFrame:
    """threshold, metric, low, high: of limits named ``max_<metric>`` and ``min_<metric>``; other names are an error."""
    rows = [(name, name[4:], float(v) if name.startswith("min_") else None, float(v) if name.startswith("max_") else None) for name, v in limits.items()]
    odd = sorted(name for name, _, low, high in rows if low is None and high is None)
    if odd:
        raise ValueError(f"limits are max_ or min_ of a metric, not {odd}")
    return spark.createDataFrame(rows, "threshold string, metric string, low double, high double")


def evaluate_thresholds(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row for each limit and row of ``metrics``: the metrics as rows, joined with the table of limits; a value that is
    null or outside its limit has not passed."""
    table = limit_table(metrics.sparkSession, limits)
    absent = sorted({name[4:] for name in limits} - set(metrics.columns))
    if absent:
        raise ValueError(f"no such metrics: {absent}")
    wanted = sorted({name[4:] for name in limits})
    measured = metrics.select([F.col(c).cast("double").alias(c) for c in wanted]).unpivot([], wanted, "metric", "value")
    inside = F.col("value").between(F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf"))))
    return measured.join(F.broadcast(table), "metric").select("threshold", F.coalesce("high", "low").alias("limit"), "value", F.coalesce(inside, F.lit(False)).alias("passed"))


def expected_vs_observed(expected: DataFrame, observed: DataFrame, rejects: DataFrame, key: str, by: str) -> DataFrame:
    """By ``by``: expected and distinct observed keys, repeats, rejects."""
    e = expected.groupBy(by).agg(F.count("*").alias("expected"))
    o = observed.groupBy(by, key).agg(F.count("*").alias("n")).groupBy(by).agg(F.count("*").alias("observed"), F.sum(F.col("n") - 1).alias("repeats"))
    r = rejects.groupBy(by).agg(F.count("*").alias("rejects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(o, by, "full_outer").join(r, by, "full_outer").select(by, zero("expected"), zero("observed"), zero("repeats"), zero("rejects"))


def compare_results(before: DataFrame, after: DataFrame, *identity: Column) -> DataFrame:
    """One row: do two results hold the same rows?"""
    from tidebook.operators.batchlog import fingerprint

    a, b = fingerprint(before, *identity), fingerprint(after, *identity)
    b = b.select(*[F.col(c).alias(f"after_{c}") for c in b.columns])
    same = (F.col("row_count") == F.col("after_row_count")) & (F.col("xor_digest") == F.col("after_xor_digest")) & (F.col("sum_digest") == F.col("after_sum_digest"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").select(same.alias("same"), F.col("row_count").alias("rows_before"), F.col("after_row_count").alias("rows_after"))
