"""Rejects found by their raw key, dry runs of replays, evidence of a trace."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidebook.operators import deadletter, reads
from tidebook.plans.contracts import SHOP

KEY = "00000000-0000-4000-8000-000000000007"
LETTERS = "dlq_id string, status string, error_code string, contract_name string, source_topic string, raw_key string, raw_value string, first_seen_at timestamp"
AT = datetime(2026, 9, 25, 10)


@pytest.mark.parametrize(
    "raw_key, contract, want",
    [
        (f'{{"order_id":"{KEY}"}}', "orders", ("shop.orders", KEY)),
        (f'{{"schema":{{}},"payload":{{"order_id":"{KEY}"}}}}', "orders", ("shop.orders", KEY)),
        (f'{{"customer_id":"{KEY}"}}', "customers", ("shop.customers", KEY)),
        ('{"order_id":7}', "orders", ("shop.orders", "7")),
        ('{"order_id":null}', "orders", (None, None)),
        ('{"customer_id":"x"}', "orders", (None, None)),
        ('["order_id"]', "orders", (None, None)),
        ("base64:/w==", "orders", (None, None)),
        (None, "orders", (None, None)),
        (f'{{"order_id":"{KEY}"}}', None, (None, None)),
    ],
)
def test_key_of_a_reject(spark, raw_key, contract, want):
    letters = spark.createDataFrame([("a", "open", "KEY_MISMATCH", contract, "cdc.shop.orders", raw_key, "", AT)], LETTERS)
    row = deadletter.with_key(letters, SHOP).first()
    assert (row.source_table, row.primary_key) == want


@pytest.fixture(scope="module")
def letters(spark):
    image = f'{{"amount":"1.00","created_at":"2026-09-25T10:00:00Z","currency":"JPY","customer_id":"{KEY}","order_id":"{KEY}","status":"PAID","updated_at":"2026-09-25T10:00:00Z"}}'
    value = f'{{"before":null,"after":{image},"op":"c","ts_ms":5,"source":{{"schema":"shop","table":"orders","lsn":1,"txId":null,"ts_ms":1,"snapshot":"false"}}}}'
    rows = [
        ("currency", "open", "CONTRACT_VIOLATION", "orders", "cdc.shop.orders", f'{{"order_id":"{KEY}"}}', value, AT),
        ("amount", "open", "CONTRACT_VIOLATION", "orders", "cdc.shop.orders", None, value.replace('"1.00"', '"1"'), AT),
        ("bytes", "open", "MALFORMED_ENCODING", "orders", "cdc.shop.orders", None, "base64:/w==", AT),
        ("topic", "open", "UNKNOWN_TOPIC", None, "cdc.shop.unknown", None, value, AT),
        ("done", "replayed", "CONTRACT_VIOLATION", "orders", "cdc.shop.orders", None, value, AT),
    ]
    return spark.createDataFrame(rows, LETTERS)


def test_candidate_contracts_on_open_rejects(letters):
    got = {(r.error_code, r.then_code): (r.records, r.accepted) for r in deadletter.reject_impact(letters, SHOP.promoted(), b"k").collect()}
    assert got == {("CONTRACT_VIOLATION", None): (1, 1), ("CONTRACT_VIOLATION", "CONTRACT_VIOLATION"): (1, 0), ("MALFORMED_ENCODING", "MALFORMED_ENCODING"): (1, 0), ("UNKNOWN_TOPIC", "UNKNOWN_TOPIC"): (1, 0)}
    now = {(r.error_code, r.then_code): (r.records, r.accepted) for r in deadletter.reject_impact(letters, SHOP, b"k").collect()}
    assert now == {(c, c): (n, 0) for c, n in (("CONTRACT_VIOLATION", 2), ("MALFORMED_ENCODING", 1), ("UNKNOWN_TOPIC", 1))}
    assert deadletter.reject_impact(letters.where("1 = 0"), SHOP, b"k").count() == 0


def test_dry_run_of_a_replay_takes_the_same_records(letters):
    records = deadletter.replay_records(letters, ids=["currency", "done", "amount"], limit=1)
    assert [r.dlq_id for r in deadletter.dry_run(records, SHOP, b"k").collect()] == ["currency"]
    rows = {r.dlq_id: (r.status, r.contract_version) for r in deadletter.dry_run(deadletter.replay_records(letters, limit=None), SHOP.promoted(), b"k").collect()}
    assert rows == {"currency": ("valid", 3), "amount": ("rejected", None), "bytes": ("rejected", None), "topic": ("rejected", None)}


def test_evidence_of_keys(spark):
    keys = spark.createDataFrame([("t", "1"), ("t", "1"), ("t", "9")], "source_table string, primary_key string")
    bronze = spark.createDataFrame([("t", "1", datetime(2026, 1, 1, 0, 0, 3), datetime(2026, 1, 1), 5, 0, 7, "c", "applied"), ("t", "2", AT, AT, 6, 0, 8, "c", "applied")], "source_table string, primary_key string, committed_at timestamp, source_ts timestamp, source_lsn long, kafka_partition int, kafka_offset long, op string, apply_outcome string")
    rejects = spark.createDataFrame([("t", "1", AT, 1, 2, "KEY_MISMATCH", "open"), (None, None, AT, 1, 3, "MALFORMED_JSON", "open")], "source_table string, primary_key string, last_seen_at timestamp, kafka_partition int, kafka_offset long, error_code string, status string")
    silver = spark.createDataFrame([("t", "1", AT, 5, True), ("u", "1", AT, 5, False)], "source_table string, primary_key string, _ingested_at timestamp, _source_lsn long, is_deleted boolean")
    got = {(r.evidence, r.result, r.source_lsn, r.kafka_offset, r.seconds) for r in reads.trace_evidence(keys, bronze, rejects, silver).collect()}
    assert got == {("event", "c applied", 5, 7, 3.0), ("reject", "KEY_MISMATCH open", None, 2, None), ("state", "deleted", 5, None, None)}
    assert reads.trace_evidence(keys, bronze.where("1 = 0"), rejects.where(F.lit(False)), silver.where("1 = 0")).count() == 0
