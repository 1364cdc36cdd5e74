"""Stream state, batch log, contract files, bounded percentiles, history tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import KEY, envelope, image, record

from tidebook.operators import alerts, batchlog, benchstats, deadletter, lineage, maintain, percentiles, quality, state
from tidebook.plans.contracts import SHOP
from tidebook.sources import contract_files, feed
from tidebook.sources.lake import LOG_SCHEMA, Lake
from tidebook.streaming import stream


@pytest.fixture(scope="module")
def frame(spark):
    return lambda records: spark.createDataFrame(records, feed.KAFKA_SCHEMA)


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def uuid(k):
    return f"00000000-0000-4000-8000-{k:012d}"


def order(k, lsn, op="c", **more):
    return envelope(op, image("orders", {"order_id": uuid(k)} | more), lsn=lsn)


def test_positions_come_from_the_kept_state(frame, lake):
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY)
    pipe.process(frame([record(order(k, 10 + k), k) for k in range(4)]), 0)
    pipe.process(frame([record(order(k, 20 + k, "u"), 10 + k) for k in range(2)]), 1)
    whole = lambda: {r.primary_key: r._source_lsn for r in lake.bronze().groupBy("primary_key").agg(F.max("source_lsn").alias("_source_lsn")).collect()}
    at = lambda b: {r.primary_key: r._source_lsn for r in lake.positions("e1", b).collect()}
    assert at(2) == whole() and at(1)[uuid(0)] == 10
    maintain.maintain(lake, ("compact",))
    pipe.process(frame([record(order(1, 40, "u"), 20), record(order(9, 41), 21)]), 2)
    assert at(3) == whole() and at(2) == {uuid(0): 20, uuid(1): 21, uuid(2): 12, uuid(3): 13}
    assert at(1) == {uuid(0): 10, uuid(1): 40, uuid(2): 12, uuid(3): 13, uuid(9): 41}
    assert all("/state/" in f for f in lake.positions("e1", 3).inputFiles())
    rows = {r.primary_key: r for r in lake.bronze().where("batch_id = 2").collect()}
    assert rows[uuid(1)].previous_lsn == 21 and rows[uuid(9)].previous_lsn is None
    folded = {r.primary_key: (r._source_lsn, r._prev_source_lsn) for r in state.current_rows(lake.bronze(), SHOP, "orders").collect()}
    assert folded[uuid(1)] == (40, 21) and folded[uuid(3)] == (13, None)
    evidence = {r.table_name: r for r in lake.spark.read.parquet(f"{lake.root}/maintenance_tables").collect()}
    assert set(evidence) == {"bronze", "rejects", "state"} and evidence["bronze"].fingerprint_match and evidence["bronze"].version_after == evidence["bronze"].version_before + 1


def test_fold_of_planned_events_equals_the_window(spark):
    rng = random.Random(3)
    rows = [("t", f"k{rng.randrange(4)}", rng.choice("cuud"), n, n // 6, f"e{n}", 1_790_000_000_000 + n, "t", 0, n) for n in range(60)]
    df = spark.createDataFrame(rows, "source_table string, primary_key string, op string, source_lsn long, batch_id long, event_id string, source_ts_ms long, kafka_topic string, kafka_partition int, kafka_offset long")
    from tidebook.operators.planner import plan_history

    planned = plan_history(df)
    with_it = {tuple(r) for r in state.fold(planned, ["kafka_offset"]).select("primary_key", "_source_lsn", "_prev_source_lsn", "is_deleted").collect()}
    without = {tuple(r) for r in state.fold(planned.drop("previous_lsn"), ["kafka_offset"]).select("primary_key", "_source_lsn", "_prev_source_lsn", "is_deleted").collect()}
    assert with_it == without
    assert "Window" not in state.fold(planned.select(*planned.columns).limit(100), ["kafka_offset"])._jdf.queryExecution().analyzed().toString().split("Aggregate")[0]


def test_batch_log_says_what_a_batch_did(frame, lake, spark, tmp_path):
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY, publish=str(tmp_path / "published"))
    pipe.process(frame([record(order(1, 5, channel="web"), 3), record(order(2, 6), 4), record(b"{broken", 5, partition=1)]), 0)
    row = lake.log().first()
    assert lake.log().columns == [f.name for f in LOG_SCHEMA] and len(LOG_SCHEMA) >= 29
    assert json.loads(row.kafka_offsets) == {"cdc.shop.orders:0": [3, 4], "cdc.shop.orders:1": [5, 5]} and row.contract_versions == "orders@1,orders@2"
    assert set(row.stage_ms) == {"decode", "bronze", "rejects"} and row.duration_ms >= max(row.stage_ms.values()) and row.spark_app_id == spark.sparkContext.applicationId
    assert row.freshness_max_ms >= row.freshness_p95_ms >= row.freshness_p50_ms > 0
    sizes = lake.files().where("path rlike '/(bronze|rejects)/'").agg(F.count("*").alias("n"), F.sum("length").alias("b")).first()
    assert (row.added_data_files, row.added_files_bytes) == (sizes.n, sizes.b)
    assert alerts.average_file_size(lake.log()).first().bytes_per_file == sizes.b / sizes.n and alerts.batch_durations(lake.log()).count() == 1
    told = spark.read.json(str(tmp_path / "published")).first()
    assert told.key == "e1:0" and json.loads(told.value)["applied"] == 2
    assert stream.publish_batches(lake.log(), "nowhere://x") is False


def test_progress_has_offsets_and_what_is_in_flight(spark, tmp_path):
    for name, text in {"offsets/0": 'v1\n{"batchWatermarkMs":0}\n{"cdc.a":{"0":7,"1":3}}', "offsets/1": 'v1\n{}\n{"cdc.a":{"0":9,"1":3}}\n{"cdc.b":{"0":2}}', "commits/0": 'v1\n{}'}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = stream.progress(spark, str(tmp_path))
    assert {(r.batch, r.committed, r.in_flight, len(r.offsets)) for r in rows.collect()} == {(0, True, False, 1), (1, False, True, 2)}
    ends = spark.createDataFrame([("cdc.a", 0, 10), ("cdc.a", 1, 3), ("cdc.b", 0, 5)], "kafka_topic string, kafka_partition int, end_offset long")
    assert batchlog.lag(ends, stream.checkpoint_offsets(rows)).first().total_lag == 3 + 5
    listener = stream.ProgressListener()
    listener.rates["q"] = {"active": True, "input_rows_per_second": 2.0, "processed_rows_per_second": 3.0, "batch_id": 4}
    assert listener.table(spark).first().batch_id == 4


def test_a_source_table_is_read_by_jdbc(spark, tmp_path):
    from tidebook.sources.source_tables import read_source

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "id long, name string")
    try:
        rows.write.jdbc(url, "source_rows", properties=driver)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no JDBC driver here: {str(e)[:80]}")
    got = read_source(spark, url, "source_rows", "ID", 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(r[0] for r in got.collect()) == list(range(50)) and read_source(spark, url, "source_rows", **driver).count() == 50
    lake_rows = rows.where("id <> 3").select(F.col("id").alias("ID"), F.when(F.col("id") == 4, "other").otherwise(F.col("name")).alias("NAME"))
    found = {(r.ID, r.difference) for r in quality.differences(lake_rows, got.select(F.col("ID"), F.col("NAME")), ["ID"], ["NAME"]).collect()}
    assert found == {(3, "missing"), (4, "different")}


# ---- contract files -------------------------------------------------------------------------------------------------


def contract_file(**meta):
    doc = {
        "type": "object", "required": ["order_id", "amount"],
        "x-own": {"contract": "orders", "version": 1, "status": "current", "source": {"table": "shop.orders", "topic": "cdc.shop.orders"}, "primary_key": ["order_id"], "freshness_sla": {"p95_seconds": 60, "max_seconds": 300}, "references": [{"field": "order_id", "contract": "orders", "target_field": "order_id"}]} | meta,
        "properties": {"order_id": {"type": "string", "format": "uuid"}, "amount": {"type": "string", "pattern": "^[0-9]+$", "x-decimal": {"precision": 12, "scale": 2}}, "channel": {"type": ["string", "null"], "enum": ["web", None]}, "name": {"type": "string", "minLength": 1, "x-pii": "direct", "x-pii-handling": "drop"}},
    }
    return doc


def test_contract_files(spark, tmp_path):
    folder = tmp_path / "contracts"
    (folder / "orders").mkdir(parents=True)
    (folder / "orders" / "v1.schema.json").write_text(json.dumps(contract_file(status="superseded")))
    (folder / "orders" / "v2.schema.json").write_text(json.dumps(contract_file(version=2)))
    (folder / "orders" / "v3.schema.json").write_text(json.dumps(contract_file(version=3, status="proposed")))
    registry = contract_files.load(spark, str(folder))
    assert [c.version for c in registry.active("orders")] == [1, 2] and [c.version for c in contract_files.load(spark, str(folder), True).active("orders")] == [1, 2, 3]
    amount, channel, name = registry.current("orders").fields[1:]
    assert (amount.decimal, channel.nullable, channel.required, channel.enum, name.column, name.min_length) == ((12, 2), True, False, ("web",), None, 1)
    (folder / "orders" / "v4.schema.json").write_text(json.dumps(contract_file(version=2)))
    with pytest.raises(contract_files.ContractError, match="twice"):
        contract_files.load(spark, str(folder))


@pytest.mark.parametrize(
    "change, what",
    [
        ({"type": "array"}, "type object"), ({"x-own": {"contract": "orders"}}, "lacks"), ({"required": ["nothing"]}, "not defined"), ({"properties": {"order_id": {"type": "uuid"}, "amount": {"type": "string"}}}, "one type"),
        ({"properties": {"order_id": {"type": "string", "format": "ip"}, "amount": {"type": "string"}}}, "format"), ({"properties": {"order_id": {"type": "string", "pattern": "("}, "amount": {"type": "string"}}}, "pattern"),
        ({"properties": {"order_id": {"type": ["string", "null"]}, "amount": {"type": "string"}}}, "must be required"), ({"properties": {"order_id": {"type": "string", "x-pii": "direct"}, "amount": {"type": "string"}}}, "hashed or dropped"),
        ({"properties": {"order_id": {"type": "string"}, "amount": {"type": "string", "x-decimal": {"precision": 2, "scale": 3}}}}, "decimal"), ({"properties": {"order_id": {"type": "string"}, "amount": {"type": "string"}, "A b": {"type": "string"}}}, "safe name"),
    ],
)
def test_faulty_contract_files_are_refused(change, what):
    with pytest.raises(contract_files.ContractError, match=what):
        contract_files.parse(json.dumps(contract_file() | change))


def test_all_faults_of_a_contract_file_are_named():
    doc = contract_file(status="odd", extra=1) | {"surprise": 1, "properties": {"order_id": {"type": "string", "x-pii": "secret", "minLength": 3, "maxLength": 2}, "amount": {"type": "string", "unit": "EUR"}}}
    got = contract_files.faults(doc)
    assert got == ["unknown top-level keywords", "unknown extension keys", "unknown status", "field order_id: bad lengths", "field order_id: unknown level of personal data", "field amount: unknown keywords"]
    with pytest.raises(contract_files.ContractError, match="surprise|top-level.*; .*status"):
        contract_files.parse(json.dumps(doc))


def test_a_broken_contract_file_keeps_the_set_before(frame, lake, spark, tmp_path):
    folder = tmp_path / "contracts"
    folder.mkdir()
    text = contract_file()
    text["properties"] = {f: {"type": "string"} for f in ("order_id", "customer_id", "status", "amount", "currency", "created_at", "updated_at")}
    (folder / "v1.schema.json").write_text(json.dumps(text))
    pipe = stream.Pipeline(lake, lambda: contract_files.load(spark, str(folder)), KEY)
    pipe.process(frame([record(order(1, 5, channel="web"), 1)]), 0)
    (folder / "v1.schema.json").write_text("{")
    pipe.process(frame([record(order(2, 6, channel="web"), 2)]), 1)
    text["properties"]["channel"] = {"type": ["string", "null"], "enum": ["fax"]}
    (folder / "v1.schema.json").write_text(json.dumps(text))
    pipe.process(frame([record(order(3, 7, channel="web"), 3), record(order(4, 8, channel="fax"), 4)]), 2)
    log = {r.batch_id: (r.valid_rows, r.dlq_rows) for r in lake.log().collect()}
    assert log == {0: (1, 0), 1: (1, 0), 2: (1, 1)}
    assert {r.primary_key: r.drift_fields for r in lake.bronze().collect()} == {uuid(1): ["channel"], uuid(2): ["channel"], uuid(4): []}


# ---- percentiles, quality history, lineage ----------------------------------------------------------------------------


def test_percentiles_are_exact_on_request(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g in range(3) for v in np.round(rng.normal(0, 40, 300 + g), rng.integers(0, 4))] + [(7, 5.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.g: [r[k] for k in wanted] for r in percentiles.percentiles(df, F.col("v"), wanted, "g", exact=True).collect()}
    for g in (0, 1, 2, 7):
        assert got[g] == pytest.approx(np.percentile([v for x, v in rows if x == g], [50, 95, 99]))
    assert 8 not in got
    whole = percentiles.percentiles(df, F.col("v"), wanted, exact=True, width=7.0).first()
    assert list(whole) == pytest.approx(np.percentile([v for _, v in rows if v is not None], [50, 95, 99]))
    near = {r.g: r.p50 for r in percentiles.percentiles(df, F.col("v"), wanted, "g").collect()}
    assert abs(near[0] - got[0][0]) < 1
    row = batchlog.statistics(df.where("g = 7"), F.col("v")).first()
    assert (row.p50, row.stddev, row.samples) == (5.5, 0.0, 1)


def test_quality_history(spark, lake):
    good = quality._row(spark.range(1).select(F.lit(0).alias("value")), "a", "d", "c", "critical")
    bad = quality._row(spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("value")), "b", "d", "c", "critical")
    at = F.lit("2026-09-25").cast("timestamp")
    quality.record(lake, quality.safe_checks({"a": good, "b": bad}), "r1", at)
    history = quality.record(lake, good, "r2", at + F.expr("INTERVAL 1 DAY"))
    got = {(r.check_id, r.run_id, r.status, r.error is not None) for r in quality.latest_results(history).collect()}
    assert got == {("a", "r2", "pass", False), ("b", "r1", "error", True)} and history.count() == 3
    recent = quality.check_history(lake, at + F.expr("INTERVAL 1 DAY"))
    assert [r.run_id for r in recent.collect()] == ["r2"]
    assert "run_date" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_a_whole_quality_run(frame, lake, spark):
    """Checks of a lake's own tables: all recorded, one that can't run is an error beside the others."""
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY)
    pipe.process(frame([record(order(k, 5 + k), k) for k in range(3)] + [record(b"{broken", 9)]), 0)
    orders = state.kept_rows(lake.state(), SHOP, "orders")
    letters = deadletter.dead_letters(lake.rejects())
    now = F.current_timestamp()
    row = quality.run_and_record(lake, SHOP, {"orders": orders}, lake.bronze(), letters, {"orders": orders.where("order_id <> '" + uuid(1) + "'")}, "run-1", now).first()
    history = {r.check_id: r for r in quality.check_history(lake).collect()}
    assert row.failed and row.critical_failures == 1 and history["dlq.open_records"].value == 1 and history["bronze.event_id_unique"].status == "pass"
    assert history["orders.source_reconciliation"].status == "fail" and {"orders.primary_key_unique", "orders.status_enum", "orders.freshness_p95"} <= set(history)
    broken = orders.withColumn("status", F.raise_error(F.lit("boom")).cast("string"))
    row = quality.run_and_record(lake, SHOP, {"orders": broken}, lake.bronze(), letters, {}, "run-2", now).first()
    errors = [r for r in quality.check_history(lake).where("run_id = 'run-2' and status = 'error'").collect()]
    assert row.failed and errors and all("boom" in r.error for r in errors) and row.passed > 0


def test_long_chains_and_unknown_nodes(spark):
    jobs = spark.createDataFrame([(f"j{k}", [f"d{k}"], [f"d{k + 1}"]) for k in range(12)], "id string, inputs array<string>, outputs array<string>")
    edges, start = lineage.edges_of(jobs), spark.createDataFrame([("d0",)], "id string")
    assert {r.id: r.depth for r in lineage.downstream(edges, start).collect()}["d12"] == 24
    nodes = spark.createDataFrame([("d0", "dataset", "x"), ("d1", "dataset", "x")], "id string, kind string, owner string")
    assert lineage.impact(edges, start, nodes).first().affected == 1
    with pytest.raises(ValueError, match="nope"):
        lineage.impact(edges, spark.createDataFrame([("nope",)], "id string"), nodes)


def test_run_documents(spark, tmp_path):
    doc = {"schema_version": 1, "run_id": "r1", "created_at": "2026-09-25", "iterations": [{"events_expected": 2, "latency_ms": [1, 2]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps(doc | {"run_id": "r2", "schema_version": 9}))
    assert [r.run_id for r in benchstats.read_runs(spark, str(tmp_path)).collect()] == ["r1"]
    good, bad = benchstats.run_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert good.faults == [] and bad.faults == ["schema_version is 9"] and bad.path.endswith("b.json")
    (tmp_path / "b.json").write_text('{"run_id": null, "schema_version": 1, "iterations": []}')
    with pytest.raises(ValueError, match="b.json: run_id is missing, created_at is missing"):
        benchstats.read_runs(spark, str(tmp_path), strict=True)
    (tmp_path / "b.json").write_text("[1")
    with pytest.raises(ValueError, match="no JSON object"):
        benchstats.read_runs(spark, str(tmp_path), strict=True)
    (tmp_path / "b.json").unlink()
    assert benchstats.read_runs(spark, str(tmp_path), strict=True).count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.json").write_text('{"run_id": "r3"}')
    assert benchstats.read_runs(spark, str(tmp_path / "c")).count() == 0


# ---- staging --------------------------------------------------------------------------------------------------------


def test_staged_tables_can_go(spark):
    from tidebook.sources import staging

    a = staging.staged(spark.range(5), "five")
    assert a.count() == 5 and a.inputFiles()
    staging.unstage(a)
    staging.unstage(spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        spark.read.parquet(a._staged_at).count()


def test_a_cluster_has_to_name_the_shared_folder():
    from types import SimpleNamespace as Fake

    from tidebook.sources import staging

    none = Fake(get=lambda *a: None)
    cluster = Fake(conf=none, sparkContext=Fake(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(cluster)


# ---- digests, sketches, progress ------------------------------------------------------------------------------------


def test_digests_find_what_the_full_join_finds(spark):
    base = spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 != 0, F.col("id") * 3).alias("a"), F.when(F.col("id") % 5 != 0, F.lit("x")).alias("b"))
    other = base.where("id <> '11'").withColumn("a", F.when(F.col("id") == "700", F.lit(None)).otherwise(F.col("a"))).withColumn("b", F.when(F.col("id") == "9", F.lit(None)).otherwise(F.col("b"))).unionByName(spark.range(1).select(F.lit("new").alias("id"), F.lit(1).cast("long").alias("a"), F.lit("y").alias("b")))
    other = other.withColumn("a", F.when(F.col("id") == "13", F.col("a") + 1).otherwise(F.col("a")))
    full = sorted(map(tuple, quality.differences(base, other, ["id"], ["a", "b"]).collect()))
    assert full == [("11", "extra"), ("13", "different"), ("9", "different"), ("new", "missing")]
    for buckets in (1, 64, 65_536):
        assert sorted(map(tuple, quality.differences_by_digest(base, other, ["id"], ["a", "b"], buckets).collect())) == full
    suspect = quality.unequal_buckets(base, other, ["id"], ["a", "b"], 1000)
    assert suspect.count() == 4
    bucket = F.pmod(F.xxhash64("id"), F.lit(1000)).alias("bucket")
    assert base.select("*", bucket).join(suspect, "bucket", "left_semi").count() < 40  # rows joined, of 4,000
    assert quality.differences_by_digest(base, base, ["id"], ["a", "b"]).count() == 0 and quality.unequal_buckets(base, base.where("false"), ["id"], ["a"], 8).count() == 8
    # a null moves between columns: another row
    swapped = [spark.createDataFrame([("k", None, "v")], "id string, a string, b string"), spark.createDataFrame([("k", "v", None)], "id string, a string, b string")]
    assert quality.differences_by_digest(*swapped, ["id"], ["a", "b"]).first().difference == "different"


def test_logged_freshness_is_within_the_sketch_bound(spark):
    rng = np.random.default_rng(4)
    ages = [(b, int(v)) for b in range(12) for v in rng.lognormal(8, 1.5, int(rng.integers(1, 3000)))]
    log = spark.createDataFrame(ages, "batch_id long, age long").groupBy("batch_id").agg(batchlog.freshness_sketch(F.col("age")).alias("freshness_sketch"), F.max("age").alias("freshness_max_ms"))
    assert log.agg(F.max(F.length("freshness_sketch"))).first()[0] < 20_000
    log = log.unionByName(spark.createDataFrame([(99, None, None)], "batch_id long, freshness_sketch string, freshness_max_ms long"))
    for row in batchlog.logged_freshness(log, F.floor(F.col("batch_id") / 4).alias("window")).collect():
        mine = np.sort([v for b, v in ages if b // 4 == row.window]) / 1000
        assert (row.events, row.longest) == (len(mine), mine[-1])
        for q, got in ((0.5, row.p50), (0.95, row.p95)):
            assert abs(np.searchsorted(mine, got) / len(mine) - q) < 0.02
    assert batchlog.logged_freshness(log).first().events == len(ages)


def test_progress_is_kept_as_a_table(frame, lake, spark, tmp_path):
    source = tmp_path / "feed"
    for k in range(2):
        frame([record(order(k, 5 + k), k)]).coalesce(1).write.mode("append").parquet(str(source))
    listener = stream.ProgressListener()
    history = stream.ProgressHistory(lake, listener, every_seconds=0.2)
    spark.streams.addListener(listener)
    try:
        seen = []
        query = feed.read_changes(spark, str(source)).writeStream.foreachBatch(lambda df, b: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
        history.close()
    rows = history.table().where(F.col("query_id") == str(query.id)).collect()
    assert {r.event for r in rows} >= {"started", "progress"} and sum(r.input_rows or 0 for r in rows) == sum(seen) == 2
    assert {r.batch_id for r in rows if r.event == "progress" and r.input_rows} == {0, 1} and all(r.duration_ms >= 0 for r in rows if r.event == "progress")
    assert listener.table(spark).count() == 1 and history.flush() == 0
