"""Contracts, decoding, planning, state, dead letters and the stream, against plain models."""

import datetime as dt
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalars
from tidebook.operators import alerts, backfill, benchstats, deadletter, lineage, maintain, quality, state
from tidebook.operators.decode import decode
from tidebook.operators.planner import plan_history
from tidebook.plans.contracts import SHOP, classify
from tidebook.sources import feed
from tidebook.sources.lake import Lake
from tidebook.streaming import stream

KEY = b"test key"
ORDER = {
    "order_id": "3f2b8f7e-5d1a-4c9b-9f60-1a2b3c4d5e6f", "customer_id": "0b7e7c1e-2f7a-4c55-8f0e-6a1d2c3b4a59", "status": "PENDING", "amount": "129.90", "currency": "USD",
    "created_at": "2026-09-25T10:00:00.123456Z", "updated_at": "2026-09-25T10:00:00.123456Z",
}
CUSTOMER = {
    "customer_id": "0b7e7c1e-2f7a-4c55-8f0e-6a1d2c3b4a59", "email": "Ada.Lovelace@example.com", "full_name": "Ada Lovelace", "country": "GB",
    "created_at": "2026-09-01T08:30:00Z", "updated_at": "2026-09-01T08:30:00Z",
}

# Rows that the contracts accept or refuse (contract, change, removed, version, codes, drift).
CASES = [
    ("orders", {}, [], 1, [], []),
    ("orders", {"channel": "web"}, [], 2, [], []),
    ("orders", {"channel": None}, [], 2, [], []),
    ("orders", {"coupon_code": "FALL26"}, [], 1, [], ["coupon_code"]),
    ("orders", {"amount": "-5.00"}, [], None, ["amount.pattern"], []),
    ("orders", {"amount": "12.345"}, [], None, ["amount.pattern", "amount.decimal"], []),
    ("orders", {"amount": 129.9}, [], None, ["amount.type"], []),
    ("orders", {"status": "SHIPPED_TO_MARS"}, [], None, ["status.enum"], []),
    ("orders", {"status": None}, [], None, ["status.null"], []),
    ("orders", {}, ["customer_id"], None, ["customer_id.required"], []),
    ("orders", {"order_id": "not-a-uuid"}, [], None, ["order_id.format"], []),
    ("orders", {"created_at": "2026-13-45T99:00:00Z"}, [], None, ["created_at.format"], []),
    ("orders", {"channel": "fax"}, [], None, ["channel.enum"], []),
    ("orders", {"currency": "JPY", "channel": "web"}, [], None, ["currency.enum"], []),
    ("customers", {}, [], 1, [], []),
    ("customers", {"email": "ada-at-example"}, [], None, ["email.format"], []),
    ("customers", {"country": "gb"}, [], None, ["country.pattern"], []),
    ("customers", {"full_name": ""}, [], None, ["full_name.min_length"], []),
]


def image(contract, change=None, removed=()):
    row = (ORDER if contract == "orders" else CUSTOMER) | (change or {})
    return {k: v for k, v in row.items() if k not in removed}


def envelope(op="c", row=None, before=None, lsn=100, tx=7, ts=1_790_000_000_000, table="orders", **more):
    after = None if op == "d" else (row or ORDER)
    return {"before": (row or ORDER) if op == "d" else before, "after": after, "op": op, "ts_ms": ts + 5, "source": {"schema": "shop", "table": table, "lsn": lsn, "txId": tx, "ts_ms": ts, "snapshot": "false"}} | more


def record(value, offset=0, topic="cdc.shop.orders", key=None, headers=(), partition=0):
    body = value if isinstance(value, (bytes, type(None))) else json.dumps(value).encode()
    if key is None and isinstance(value, dict):
        row = value.get("after") or value.get("before")
        name = "order_id" if topic == "cdc.shop.orders" else "customer_id"
        key = json.dumps({name: row[name]}).encode() if isinstance(row, dict) and name in row else None
    return (key, body, topic, partition, offset, dt.datetime(2026, 9, 25), 0, [(k, v.encode()) for k, v in headers])


@pytest.fixture(scope="module")
def frame(spark):
    return lambda records: spark.createDataFrame(records, feed.KAFKA_SCHEMA)


# ---- contracts and decoding -----------------------------------------------------------------------------------------


def test_corpus(spark):
    rows = [(i, c, json.dumps(image(c, change, removed))) for i, (c, change, removed, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, contract_name string, j string").withColumn("image", F.parse_json("j"))
    got = {r.i: r for r in classify(df, "image", "contract_name", SHOP).drop("image").collect()}
    for i, (_, _, _, version, codes, drift) in enumerate(CASES):
        assert (got[i].version, got[i].violations, got[i].drift_fields) == (version, codes, drift)
    then = {r.i: r.version for r in classify(df, "image", "contract_name", SHOP.promoted()).drop("image").collect()}
    assert then[13] == 3


def test_decode_names_the_first_fault(frame):
    bad = [
        ("MALFORMED_JSON", record(b"{not json")), ("MALFORMED_ENCODING", record(b"\xff\xfe\xfd")), ("INVALID_ENVELOPE", record(b"[1, 2]")), ("INVALID_ENVELOPE", record(envelope(lsn="12"))),
        ("INVALID_ENVELOPE", record(envelope(lsn=True))), ("INVALID_ENVELOPE", record(envelope(lsn=-1))), ("INVALID_ENVELOPE", record(envelope(table="customers"))), ("UNSUPPORTED_OP", record(envelope(op="t"))),
        ("MISSING_ROW_IMAGE", record(envelope() | {"after": None})), ("CONTRACT_VIOLATION", record(envelope(row=image("orders", {"amount": "-5.00"})))), ("KEY_MISMATCH", record(envelope(), key=b'{"order_id": "x"}')),
        ("KEY_MISMATCH", record(envelope(), key=b"nonsense")), ("UNKNOWN_TOPIC", record(envelope(), topic="elsewhere")), ("MALFORMED_ROW_IMAGE", record(envelope(op="u", before=image("orders", {"created_at": "bad"})))),
        ("INVALID_ENVELOPE", record(envelope() | {"before": 3})), ("INVALID_ENVELOPE", record({"after": ORDER})),
    ]
    records = [r[:4] + (i,) + r[5:] for i, (_, r) in enumerate(bad)] + [record(None, 99), record(envelope(), 100), record(envelope(), 101, key=json.dumps({"schema": {}, "payload": {"order_id": ORDER["order_id"]}}).encode())]
    got = {r.kafka_offset: r for r in decode(frame(records), SHOP, KEY).collect()}
    assert [got[i].error_code for i in range(len(bad))] == [c for c, _ in bad]
    assert all(got[i].status == "rejected" and got[i].raw_value for i in range(len(bad))) and got[1].raw_value == "base64://79"
    assert got[99].status == "tombstone" and got[100].status == got[101].status == "valid" and got[100].raw_value is None


def test_decode_equals_hashlib(frame):
    value = envelope(row=image("orders", {"note": "é\n\"q\""}), lsn=77, tx=None)
    customer = envelope(row=CUSTOMER, table="customers")
    got = {r.kafka_offset: r for r in decode(frame([record(value, 1), record(customer, 2, "cdc.shop.customers")]), SHOP, KEY).collect()}
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row_hash = hashlib.sha256(canonical({"before": None, "after": value["after"]}).encode()).hexdigest()
    want = hashlib.sha256("|".join(["shop.orders", ORDER["order_id"], "77", "", "c", row_hash]).encode()).hexdigest()
    assert got[1].event_id == want and got[1].after_json == canonical(ORDER) and got[1].drift_fields == ["note"] and got[1].before_json is None
    stored = json.loads(got[2].after_json)
    assert stored["email_hmac"] == hmac.new(KEY, b"ada.lovelace@example.com", hashlib.sha256).hexdigest() and "full_name" not in stored and stored["created_at"] == "2026-09-01T08:30:00.000000Z"


def test_scalars(spark):
    df = spark.createDataFrame([(0x16B374D848,), (0,), (-1,)], "lsn long")
    rows = df.select(scalars.lsn_text(F.col("lsn")).alias("t"), scalars.lsn_number(scalars.lsn_text(F.col("lsn"))).alias("n")).collect()
    assert [r.t for r in rows] == ["16/B374D848", "0/0", None] and [r.n for r in rows] == [0x16B374D848, 0, None]
    nums = spark.range(1, 11).agg(*[F.percentile("id", q) for q in (0.5, 0.95, 0.99)]).first()
    assert [round(x, 2) for x in nums] == [5.5, 9.55, 9.91]


# ---- planning -------------------------------------------------------------------------------------------------------


def model(history, lateness):
    """Batch by batch, event by event."""
    seen, top, mark, out = set(), {}, 0, {}
    for batch in sorted({e["batch_id"] for e in history}):
        rows = sorted((e for e in history if e["batch_id"] == batch), key=lambda e: (e["kafka_partition"], e["kafka_offset"]))
        fresh = []
        for e in rows:
            if e["event_id"] in seen:
                out[e["kafka_partition"], e["kafka_offset"]] = ("duplicate", None)
            else:
                seen.add(e["event_id"])
                fresh.append(e)
        last = {}
        for e in fresh:
            if e["primary_key"] not in last or (e["source_lsn"], e["kafka_offset"]) > (last[e["primary_key"]]["source_lsn"], last[e["primary_key"]]["kafka_offset"]):
                last[e["primary_key"]] = e
        before = dict(top)
        for e in fresh:
            k = e["primary_key"]
            outcome = "stale" if k in before and e["source_lsn"] <= before[k] else "applied" if last[k] is e else "superseded"
            out[e["kafka_partition"], e["kafka_offset"]] = (outcome, e["source_ts_ms"] < mark)
            top[k] = max(top.get(k, -1), e["source_lsn"])
        if fresh:
            mark = max(mark, max(e["source_ts_ms"] for e in fresh) - lateness)
    return out


def history(seed):
    rng = random.Random(seed)
    events = [{"event_id": f"e{n}", "source_table": "t", "primary_key": f"k{rng.randrange(5)}", "op": rng.choice("cuud"), "source_lsn": 1000 + n, "source_ts_ms": 1_790_000_000_000 + n * 20_000} for n in range(40)]
    rows = events + [dict(rng.choice(events)) for _ in range(12)]
    rng.shuffle(rows)
    return [r | {"kafka_topic": "t", "kafka_partition": 0, "kafka_offset": i, "batch_id": i // 7, "v": r["source_lsn"]} for i, r in enumerate(map(dict, rows))]


def test_history_plan_equals_model(spark):
    for seed in range(4):
        rows = history(seed)
        planned = plan_history(spark.createDataFrame(rows), 60_000)
        got = {(r.kafka_partition, r.kafka_offset): (r.apply_outcome, r.is_late) for r in planned.collect()}
        assert got == model(rows, 60_000)
        folded = {r.primary_key: (r._source_lsn, r.is_deleted) for r in state.fold(planned, ["v"]).collect()}
        last = {}
        for r in sorted(rows, key=lambda r: r["source_lsn"]):
            last[r["primary_key"]] = (r["source_lsn"], r["op"] == "d")
        assert folded == last


def test_fold(spark):
    rows = [("A", "c", 100, 1), ("A", "u", 101, 2), ("A", "d", 103, 9), ("B", "d", 30, 5), ("C", "d", 30, 5), ("C", "c", 31, 6)]
    df = spark.createDataFrame([("t", k, op, lsn, v, "applied") for k, op, lsn, v in rows], "source_table string, primary_key string, op string, source_lsn long, v int, apply_outcome string")
    got = {r.primary_key: (r.v, r.is_deleted, r._source_lsn, r._prev_source_lsn) for r in state.fold(df, ["v"]).collect()}
    assert got == {"A": (2, True, 103, 101), "B": (5, True, 30, None), "C": (6, False, 31, 30)}


# ---- stream, dead letters, maintenance ------------------------------------------------------------------------------


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def rows_of(lake):
    return sorted((r.event_id, r.apply_outcome, r.is_late) for r in lake.bronze().collect())


def test_stream_replay_and_dead_letters(frame, lake):
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY)
    a, b = image("orders"), image("orders", {"order_id": "0b7e7c1e-2f7a-4c55-8f0e-6a1d2c3b4a59"})
    first = [record(envelope("c", a, lsn=100), 1), record(envelope("u", a, lsn=101), 2), record(envelope("c", b, lsn=102), 3), record(b"{broken", 4), record(None, 5), record(envelope("c", image("orders", {"amount": "-1.00"}), lsn=105), 6)]
    pipe.process(frame(first), 0)
    once = rows_of(lake)
    pipe.process(frame(first), 0)  # a replay after the log was written
    assert rows_of(lake) == once and len(once) == 3
    log = lake.log().orderBy("started_at").collect()
    assert len(log) == 2 and [(r.applied, r.superseded, r.duplicates, r.dlq_rows, r.tombstones) for r in log] == [(2, 1, 0, 2, 1)] * 2
    pipe.process(frame([record(envelope("d", a, lsn=103), 7), record(envelope("c", a, lsn=100), 8), record(envelope("u", a, lsn=50, ts=1_700_000_000_000), 9)]), 1)
    now = {r.apply_outcome: r for r in lake.bronze().where("batch_id = 1").collect()}
    assert set(now) == {"applied", "stale"} and now["stale"].is_late
    rows = {r.order_id: r for r in state.current_rows(lake.bronze(), SHOP, "orders").collect()}
    assert rows[ORDER["order_id"]].is_deleted and str(rows[b["order_id"]].amount) == "129.90"
    letters = {r.error_code: r for r in deadletter.dead_letters(lake.rejects()).collect()}
    assert set(letters) == {"MALFORMED_JSON", "CONTRACT_VIOLATION"} and all(r.status == "open" for r in letters.values())
    again = deadletter.replay_records(deadletter.dead_letters(lake.rejects()), error_code="CONTRACT_VIOLATION").first()
    fixed = record(bytes(again.value).replace(b"-1.00", b"1.00"), 10, again.topic, bytes(again.key), [(h.key, bytes(h.value).decode()) for h in again.headers])
    pipe.process(frame([fixed]), 2)
    letters = {r.error_code: r for r in deadletter.dead_letters(lake.rejects()).collect()}
    assert (letters["CONTRACT_VIOLATION"].status, letters["CONTRACT_VIOLATION"].replay_attempts, letters["CONTRACT_VIOLATION"].resolved_batch_id) == ("replayed", 1, 2)


def test_unlogged_attempt_is_invisible_then_orphan(frame, lake, spark):
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY)
    pipe.process(frame([record(envelope(lsn=1), 1)]), 0)
    seen = rows_of(lake)
    half = lake.bronze().withColumns({"attempt_id": F.lit("crashed"), "batch_id": F.lit(1).cast("long")})
    lake.append("bronze", half, "source_date", "stream_epoch", "batch_id", "attempt_id")
    assert rows_of(lake) == seen
    soon = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    assert {r.attempt_id for r in maintain.orphan_files(lake, "1s", soon).collect()} == {"crashed"}
    row = maintain.maintain(lake, keep="0s", delete=True).first()
    assert row.status == "succeeded" and row.fingerprint_match is None and row.orphan_files >= 1 and rows_of(lake) == seen
    pipe.process(frame([record(envelope("u", lsn=2), 2)]), 1)
    assert len(rows_of(lake)) == 2
    with pytest.raises(ValueError):
        maintain.maintain(lake, ("vacuum",))
    with pytest.raises(ValueError):
        maintain.parse_size("3 MB")


def test_available_now_equals_batches(frame, lake, spark, tmp_path):
    source = tmp_path / "feed"
    for k in range(2):
        frame([record(envelope("c", image("orders", {"order_id": f"00000000-0000-4000-8000-{10 * k + i:012d}"}), lsn=10 * k + i), 10 * k + i) for i in range(3)]).coalesce(1).write.mode("append").parquet(str(source))
    pipe = stream.Pipeline(lake, lambda: SHOP, KEY, stream.new_epoch(lake, str(tmp_path / "check")))
    query = pipe.start(feed.read_changes(spark, str(source)), str(tmp_path / "check"), every=None)
    query.awaitTermination(120)
    assert lake.log().count() == 2 and lake.log().agg(F.sum("applied")).first()[0] == lake.bronze().count() == 6
    assert stream.progress(spark, str(tmp_path / "check")).where("committed").count() == 2
    assert stream.new_epoch(lake, str(tmp_path / "check")) == pipe.epoch


# ---- quality, lineage, statistics, backfill --------------------------------------------------------------------------


def test_safe_checks_report_errors(spark):
    good = quality._row(spark.range(1).select(F.lit(0).alias("value")), "a", "d", "c", "critical")
    bad = quality._row(spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("value")), "b", "d", "c", "critical")
    got = {r.check_id: r.status for r in quality.safe_checks({"a": good, "b": bad}).collect()}
    assert got == {"a": "pass", "b": "error"} and quality.verdict(quality.safe_checks({"a": good, "b": bad})).first().failed


def test_lineage_with_a_cycle(spark):
    jobs = spark.createDataFrame([("j1", ["a"], ["b"]), ("j2", ["b"], ["c", "a"])], "id string, inputs array<string>, outputs array<string>")
    edges = lineage.edges_of(jobs)
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in lineage.downstream(edges, start).collect()} == {"a": 0, "j1": 1, "b": 2, "j2": 3, "c": 4}
    assert {r.id for r in lineage.upstream(edges, start).collect()} == {"a", "j2", "b", "j1"}
    faults = lineage.integrity(spark.createDataFrame([("a",), ("a",), ("j1",), ("b",)], "id string"), jobs)
    assert {(r.id, r.fault) for r in faults.collect()} == {("a", "duplicate"), ("j1", "dataset_and_job"), ("c", "dangling")}


def test_statistics_and_thresholds(spark):
    row = spark.createDataFrame([(10, 8, 1, 2, 0, 4000)], "events_expected long, events_observed long, duplicates_observed long, dlq_events long, first_source_ms long, last_commit_ms long")
    got = benchstats.iteration_summary(row).first()
    assert (got.throughput_eps, got.loss_rate, got.duplicate_rate, got.error_rate) == (2.0, 0.2, 0.125, 0.2)
    with pytest.raises(ValueError):
        benchstats.evaluate_thresholds(row, {"max_nothing": 1})
    assert [r.passed for r in benchstats.evaluate_thresholds(row.select(F.lit(None).cast("double").alias("x")), {"max_x": 1}).collect()] == [False]


def test_incidents(spark):
    rows = [("a", 1, "healthy"), ("a", 2, "down"), ("a", 3, "degraded"), ("a", 4, "healthy"), ("a", 5, "down"), ("b", 1, "healthy")]
    probes = spark.createDataFrame([(c, t, t, s) for c, t, s in rows], "component string, ts long, probe_id long, status string")
    assert [tuple(r) for r in alerts.incidents(probes).orderBy("opened_at").collect()] == [("a", 2, "down", 4), ("a", 5, "down", None)]
    assert alerts.overall_status(alerts.latest_status(probes)).first().status == "down" and alerts.overall_status(alerts.latest_status(probes.where("1 = 0"))).first().status == "unknown"


def test_backfill_round_trip(spark):
    rows = spark.createDataFrame([tuple(ORDER.values())], ", ".join(f"{k} string" for k in ORDER)).withColumns({c: F.to_timestamp(c) for c in ("created_at", "updated_at")})
    chosen = backfill.select_rows(rows, "order_id", [ORDER["order_id"].upper()])
    records = backfill.as_envelopes(chosen, SHOP.active("orders")[0], F.lit(9), F.lit(1_790_000_000_000), "cdc.shop.orders")
    got = decode(records, SHOP, KEY).first()
    assert (got.status, got.op, got.source_lsn, got.source_snapshot) == ("valid", "r", 9, "backfill")
    with pytest.raises(ValueError):
        backfill.select_rows(rows, "order_id", ["x"] * 501)
    with pytest.raises(ValueError):
        backfill.select_rows(rows, since=dt.datetime(2026, 1, 1))
