"""Quality checks generated from the contracts: each is one lazy row with a number, and they run in turn.

A check passes when its number is at most its threshold; no number is ``no_data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import any_of, seconds_between
from tidebook.operators.percentiles import percentiles
from tidebook.operators.state import live
from tidebook.plans.contracts import Registry
from tidebook.sources.staging import short_shuffles

RECONCILE_GRACE_SECONDS, FRESH_MINUTES = 120, 60
CHECK_SCHEMA = "check_id string, dataset string, category string, severity string, status string, value double, threshold double, unit string"


def _row(value: DataFrame, check: str, dataset: str, category: str, severity: str, threshold: float = 0.0, unit: str = "rows") -> DataFrame:
    v = F.col("value").cast("double")
    status = F.when(v.isNull(), "no_data").when(v <= threshold, "pass").otherwise("fail")
    return value.select(
        F.lit(check).alias("check_id"), F.lit(dataset).alias("dataset"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        status.alias("status"), v.alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(unit).alias("unit"),
    )


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Rows beyond the first of each key; counted from partial counts, so no key gathers in one task."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value"))


def count_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("value"))


def orphans(child: DataFrame, field: str, parent: DataFrame, target: str, as_of: Column, grace_seconds: int) -> DataFrame:
    """Live rows, older than the grace, whose reference finds no live parent."""
    old = live(child).where(F.col(field).isNotNull() & (F.col("_ingested_at") < as_of - F.make_dt_interval(secs=F.lit(grace_seconds))))
    return old.join(live(parent).select(F.col(target).alias(field)).distinct(), field, "left_anti")


def differences(lake: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys on one side only, or with a column that differs (null-safe), with what is wrong."""
    left = lake.select(*key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_lake"))
    right = source.select(*key, *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("_source"))
    both = left.join(right, key, "full_outer")
    unequal = any_of(*[~F.col(f"l_{c}").eqNullSafe(F.col(f"s_{c}")) for c in columns])
    what = F.when(F.col("_lake").isNull(), "missing").when(F.col("_source").isNull(), "extra").when(unequal, "different")
    return both.withColumn("difference", what).where("difference is not null").select(*key, "difference")


def bucket_digests(rows: DataFrame, key: list[str], columns: list[str], buckets: int) -> DataFrame:
    """bucket, rows and an order-free digest of each bucket of keys; nulls count, and where they stand."""
    each = F.xxhash64(*[x for c in [*key, *columns] for x in (F.col(c), F.col(c).isNull())])
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, each.alias("h")).groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


def unequal_buckets(lake: DataFrame, source: DataFrame, key: list[str], columns: list[str], buckets: int) -> DataFrame:
    """Buckets of keys whose rows aren't the same on both sides; ``buckets`` rows at most."""
    a, b = (bucket_digests(rows, key, columns, buckets) for rows in (lake, source))
    left, right = (x.select("bucket", F.struct("n", "x", "s").alias(side)) for x, side in ((a, "l"), (b, "r")))
    return left.join(right, "bucket", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")


def differences_by_digest(lake: DataFrame, source: DataFrame, key: list[str], columns: list[str], buckets: int = 65_536) -> DataFrame:
    """``differences``, for sides that are nearly equal: both are summed up by buckets of keys, partial before the shuffle, and
    only the rows of unequal buckets are joined.  Column types of both sides have to be the same."""
    suspect = F.broadcast(unequal_buckets(lake, source, key, columns, buckets))  # bounded by the number of buckets
    near = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).join(suspect, "bucket", "left_semi")
    return differences(near(lake), near(source), key, columns)


def contract_checks(registry: Registry, name: str, rows: DataFrame) -> list[DataFrame]:
    """Uniqueness, completeness and validity of one current-state table; all counts of single rows are one aggregation."""
    out = [_row(repeated_keys(rows, "primary_key"), f"{name}.primary_key_unique", name, "uniqueness", "critical")]
    columns = registry.columns(name)
    counted = {f"{name}.required_not_null": ("completeness", any_of(*[F.col(f.column).isNull() for f in columns if f.required and not f.nullable]))}
    counted |= {f"{name}.{f.name}_enum": ("validity", F.col(f.column).isNotNull() & ~F.col(f.column).isin(*f.enum)) for f in columns if f.enum}
    one = live(rows).agg(*[F.count_if(bad).alias(f"n{k}") for k, (_, bad) in enumerate(counted.values())])
    each = F.array(*[F.struct(F.lit(check).alias("check_id"), F.lit(category).alias("category"), F.col(f"n{k}").cast("double").alias("value")) for k, (check, (category, _)) in enumerate(counted.items())])
    found = one.select(F.explode(each).alias("c")).select("c.*")
    out.append(found.select("check_id", F.lit(name).alias("dataset"), "category", F.lit("critical").alias("severity"), F.when(F.col("value") <= 0, "pass").otherwise("fail").alias("status"), "value", F.lit(0.0).alias("threshold"), F.lit("rows").alias("unit")))
    return out


def reference_checks(registry: Registry, tables: dict[str, DataFrame], as_of: Column) -> list[DataFrame]:
    out = []
    for name in registry.names:
        for r in registry.current(name).references:
            if name in tables and r.contract in tables:
                found = orphans(tables[name], r.field, tables[r.contract], r.target, as_of, r.grace_seconds).agg(F.count("*").alias("value"))
                out.append(_row(found, f"{name}.{r.field}_references_{r.contract}", name, "referential_integrity", "warning"))
    return out


def reconciliation_check(registry: Registry, name: str, rows: DataFrame, source: DataFrame, as_of: Column) -> DataFrame:
    """Row for row against the source on the earliest version's kept columns; rows changed within the grace don't count."""
    first = registry.active(name)[0]
    columns = [f.name for f in first.fields if f.pii == "keep" and f.name not in first.key]
    settled = as_of - F.make_dt_interval(secs=F.lit(RECONCILE_GRACE_SECONDS))
    lake = live(rows).select(*first.key, *columns, "_source_ts")
    own = source.select(*first.key, *columns)
    left = lake.select(*first.key, *[F.col(c).alias(f"l_{c}") for c in columns], "_source_ts", F.lit(True).alias("_lake"))
    right = own.select(*first.key, *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("_source"))
    both = left.join(right, list(first.key), "full_outer").where(F.coalesce(F.col("s_updated_at"), F.col("_source_ts")) <= settled)
    wrong = F.col("_lake").isNull() | F.col("_source").isNull() | any_of(*[~F.col(f"l_{c}").eqNullSafe(F.col(f"s_{c}")) for c in columns])
    return _row(count_where(both, wrong), f"{name}.source_reconciliation", name, "reconciliation", "critical")


def freshness_check(registry: Registry, name: str, bronze: DataFrame, as_of: Column, exact: bool = False) -> DataFrame:
    c = registry.current(name)
    recent = bronze.where((F.col("source_table") == c.table) & (F.col("apply_outcome") == "applied") & (F.col("committed_at") >= as_of - F.make_dt_interval(mins=F.lit(FRESH_MINUTES))))
    p95 = percentiles(recent, seconds_between(F.col("committed_at"), F.col("source_ts")), {"value": 0.95}, exact=exact).agg(F.max("value").alias("value"))
    return _row(p95, f"{name}.freshness_p95", name, "freshness", "warning", c.p95_seconds, "seconds")


def row_checks(registry: Registry, tables: dict[str, DataFrame], sources: dict[str, DataFrame], as_of: Column) -> list[DataFrame]:
    """The checks of current-state tables; the list follows from the contracts.  Each table is read by several checks, so pass
    tables that lie written rather than plans that are long to compute."""
    out: list[DataFrame] = []
    for name in registry.names:
        if name in tables:
            out += contract_checks(registry, name, tables[name])
            if name in sources:
                out.append(reconciliation_check(registry, name, tables[name], sources[name], as_of))
    return out + reference_checks(registry, tables, as_of)


def event_checks(registry: Registry, names: list[str], bronze: DataFrame, letters: DataFrame, as_of: Column, exact: bool = False) -> list[DataFrame]:
    """The checks of the named contracts' events and of the dead letters; ``bronze`` is read by several, like a table above."""
    out = [freshness_check(registry, name, bronze, as_of, exact) for name in registry.names if name in names]
    out.append(_row(repeated_keys(bronze, "event_id"), "bronze.event_id_unique", "bronze", "uniqueness", "critical"))
    out.append(_row(count_where(letters, F.col("status") == "open"), "dlq.open_records", "dlq", "dead_letters", "warning"))
    return out


def run_in_turn(checks: list[DataFrame]) -> list[Row]:
    """The checks' rows, each check run on its own: the shuffles of one check at a time lie on disk.  One that fails, fails all;
    ``safe_checks`` reports it."""
    with short_shuffles(checks[0].sparkSession):
        return [r for check in checks for r in check.select("*").collect()]  # a few rows a check; selected, so made in here


def as_table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """The rows of checks that ran, in one partition, so that a verdict shuffles nothing."""
    return spark.createDataFrame(rows, CHECK_SCHEMA).coalesce(1)


def run_checks(checks: DataFrame, run_id: str, run_at: Column, runner: str = "batch") -> DataFrame:
    """Checks as history rows."""
    return checks.select(F.lit(run_id).alias("run_id"), run_at.alias("run_at"), "check_id", "dataset", "category", "severity", "status", "value", "threshold", "unit", F.lit(None).cast("string").alias("error"), F.lit(runner).alias("runner"))


def record(lake, checks: DataFrame, run_id: str, run_at: Column, runner: str = "batch") -> DataFrame:
    """Append a run's checks to the lake's history, a folder a day, and return the history; ``error`` comes with checks that
    have it."""
    rows = run_checks(checks, run_id, run_at, runner)
    if "error" in checks.columns:
        rows = checks.select(*[F.lit(run_id).alias(c) if c == "run_id" else run_at.alias(c) if c == "run_at" else F.lit(runner).alias(c) if c == "runner" else F.col(c) for c in rows.columns])
    lake.append("quality", rows.withColumn("run_date", F.to_date("run_at")).coalesce(1), "run_date")
    return check_history(lake)


def check_history(lake, since: Column | None = None) -> DataFrame:
    """All recorded checks, or those of the days from a date on: other days' files aren't opened."""
    rows = lake.spark.read.parquet(f"{lake.root}/quality")
    return rows if since is None else rows.where(F.col("run_date") >= F.to_date(since))


def run_and_record(lake, registry: Registry, tables: dict[str, DataFrame], bronze: DataFrame, letters: DataFrame, sources: dict[str, DataFrame], run_id: str, as_of: Column, runner: str = "batch") -> DataFrame:
    """A whole run: every check of the contracts on its own, so that one that fails is an ``error`` row beside the others, all
    recorded; returns the run's verdict."""
    named = {}
    for name in registry.names:
        if name in tables:
            for k, check in enumerate(contract_checks(registry, name, tables[name])):
                named[f"{name}.contract_{k}"] = check
            if name in sources:
                named[f"{name}.source_reconciliation"] = reconciliation_check(registry, name, tables[name], sources[name], as_of)
            named[f"{name}.freshness_p95"] = freshness_check(registry, name, bronze, as_of)
    named |= {f"reference_{k}": check for k, check in enumerate(reference_checks(registry, tables, as_of))}
    named["bronze.event_id_unique"] = _row(repeated_keys(bronze, "event_id"), "bronze.event_id_unique", "bronze", "uniqueness", "critical")
    named["dlq.open_records"] = _row(count_where(letters, F.col("status") == "open"), "dlq.open_records", "dlq", "dead_letters", "warning")
    history = record(lake, safe_checks(named), run_id, as_of, runner)
    return verdict(history.where(F.col("run_id") == run_id))


def safe_checks(named: dict[str, DataFrame]) -> DataFrame:
    """Run each check on its own, so that one that fails becomes an ``error`` row and the others still run."""
    out = None
    for name, check in named.items():
        try:
            row = check.sparkSession.createDataFrame(check.collect(), check.schema).withColumn("error", F.lit(None).cast("string"))  # one row
        except Exception as e:  # noqa: BLE001 - any failure of a check is its result
            text = str(e)[:500]
            row = check.sparkSession.range(1).select(
                F.lit(name).alias("check_id"), F.lit("").alias("dataset"), F.lit("").alias("category"), F.lit("critical").alias("severity"), F.lit("error").alias("status"),
                F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.lit("").alias("unit"), F.lit(text).alias("error"),
            )
        out = row if out is None else out.unionByName(row)
    return out


def latest_results(history: DataFrame) -> DataFrame:
    last = Window.partitionBy("check_id").orderBy(F.col("run_at").desc(), F.col("run_id").desc())
    return history.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def verdict(results: DataFrame) -> DataFrame:
    """One row: failed (any error, or a critical failure), the numbers by status, and the warnings."""
    s, severity = F.col("status"), F.col("severity")
    critical = (s == "error") | ((s == "fail") & (severity == "critical"))
    warned = F.when((s == "fail") & (severity == "warning"), F.col("check_id"))
    return results.agg(
        (F.count_if(critical) > 0).alias("failed"), F.count_if(s == "pass").alias("passed"), F.count_if(critical).alias("critical_failures"),
        F.array_join(F.array_sort(F.collect_set(warned)), ",").alias("warnings"),
    )
