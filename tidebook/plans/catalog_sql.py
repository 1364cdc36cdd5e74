"""DuckDB twins of the registered queries."""

from __future__ import annotations

_FEED = """
f AS (
  SELECT concat('o', CAST(o_orderkey AS VARCHAR), '-', CAST(v AS VARCHAR)) AS eid, o_orderkey AS pk, v,
    CASE WHEN v = 1 THEN 'c' WHEN v = 3 THEN 'd' ELSE 'u' END AS op, o_orderkey * 10 + v AS lsn,
    1790000000000 + (o_orderkey * 10 + v) * 100 AS ts_ms, o_orderkey % 3 AS part, (o_orderkey * 10 + v) * 2 + r AS off,
    (o_orderkey * 8 // (SELECT count(*) FROM orders)) + CASE WHEN (o_orderkey + v) % 11 = 0 THEN 2 WHEN v = 2 AND o_orderkey % 4 = 1 THEN 1 ELSE 0 END + r AS batch,
    o_custkey, o_orderstatus, CAST(o_totalprice + v AS DECIMAL(12,2)) AS amount
  FROM orders CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) vv CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1) rr
  WHERE (v = 1 OR (v = 2 AND o_orderkey % 10 < 6) OR (v = 3 AND o_orderkey % 10 IN (1, 9))) AND (r = 0 OR (o_orderkey + v) % 7 = 0))"""

_PLAN = (
    _FEED
    + """,
d AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY batch, part, off) AS rn FROM f),
b AS (SELECT batch, max(CASE WHEN rn = 1 THEN ts_ms END) AS mx FROM d GROUP BY batch),
w AS (SELECT batch, greatest(0, coalesce(max(mx) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300000, 0)) AS wm FROM b),
c AS (
  SELECT d.*, w.wm,
    max(CASE WHEN rn = 1 THEN lsn END) OVER (PARTITION BY pk ORDER BY d.batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base,
    row_number() OVER (PARTITION BY pk, d.batch ORDER BY CASE WHEN rn = 1 THEN lsn END DESC NULLS LAST, off DESC) AS kr
  FROM d JOIN w ON d.batch = w.batch),
p AS (
  SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN lsn <= base THEN 'stale' WHEN kr > 1 THEN 'superseded' ELSE 'applied' END AS outcome,
    CASE WHEN rn = 1 THEN ts_ms < wm END AS late
  FROM c)"""
)

_COMMITTED = _PLAN + ", k AS (SELECT p.*, max(ts_ms) OVER (PARTITION BY batch) + 5000 AS commit_ms FROM p)"

_LOG = (
    _COMMITTED
    + """,
log AS (
  SELECT batch, commit_ms, count(*) AS n, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'applied') AS applied,
    count(*) FILTER (outcome = 'superseded') AS superseded, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (coalesce(late, false)) AS late_rows,
    count(*) % 7 AS dlq_rows, batch % 4 AS commit_retries, 100 + count(*) % 1000 AS duration_ms
  FROM k GROUP BY batch, commit_ms)"""
)


def _fold(source: str, name: str = "s", extra: str = "") -> str:
    def data(c: str) -> str:
        return f"CASE WHEN count(*) FILTER (op <> 'd') > 0 THEN arg_max({c}, lsn) FILTER (op <> 'd') ELSE arg_min({c}, lsn) FILTER (op = 'd') END AS {c}"

    return f"""{name} AS (
  SELECT pk, {data('o_custkey')}, {data('o_orderstatus')}, {data('amount')}, arg_max(op, lsn) = 'd' AS is_deleted, max(lsn) AS top,
    CASE WHEN count(*) > 1 THEN list_sort(list(lsn), 'DESC')[2] END AS prev, arg_max(op, lsn) AS last_op {extra}
  FROM {source} GROUP BY pk)"""


_SILVER = _PLAN + ", " + _fold("(SELECT * FROM p WHERE outcome = 'applied')")
_COMMITTED_SILVER = _COMMITTED + ", " + _fold("(SELECT * FROM k WHERE outcome = 'applied')", extra=", arg_max(commit_ms, lsn) AS commit_ms")


def _uuid(x: str) -> str:
    return f"concat('00000000-0000-4000-8000-', lpad(CAST({x} AS VARCHAR), 12, '0'))"


def _error(amount: bool = True) -> str:
    bad = "pk % 97 = 0 OR pk % 53 = 0" if amount else "pk % 53 = 0"
    return f"""CASE WHEN pk % 67 = 0 THEN 'UNKNOWN_TOPIC' WHEN pk % 73 = 0 THEN 'MALFORMED_ENCODING' WHEN pk % 101 = 0 THEN 'MALFORMED_JSON'
      WHEN pk % 89 = 0 THEN 'UNSUPPORTED_OP' WHEN pk % 79 = 0 THEN 'INVALID_ENVELOPE' WHEN pk % 71 = 0 THEN 'MISSING_ROW_IMAGE'
      WHEN {bad} THEN 'CONTRACT_VIOLATION' WHEN pk % 83 = 0 THEN 'KEY_MISMATCH' WHEN pk % 61 = 0 AND op = 'u' THEN 'MALFORMED_ROW_IMAGE' END"""


_BROKEN = "concat_ws(',', CASE WHEN pk % 97 = 0 THEN 'amount.pattern' END, CASE WHEN pk % 53 = 0 THEN 'currency.enum' END)"
_DECODED = _FEED + f", e AS (SELECT *, {_error()} AS err FROM f)"
_IMAGES = _FEED + ", i AS (SELECT * FROM f WHERE pk % 73 <> 0 AND pk % 101 <> 0 AND pk % 71 <> 0 AND op <> 'd')"
_AT = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ')"
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PAID' ELSE 'SHIPPED' END"
_IMAGE = f"""concat('{{"amount":"', amount, '"', CASE WHEN pk % 13 = 0 THEN ',"channel":"web"' ELSE '' END, ',"created_at":"', {_AT}, '","currency":"',
  CASE WHEN pk % 2 = 0 THEN 'USD' ELSE 'EUR' END, '","customer_id":"', {_uuid('o_custkey')}, '","order_id":"', {_uuid('pk')}, '","status":"', {_STATE}, '","updated_at":"', {_AT}, '"}}')"""

_LETTERS = (
    _FEED
    + f""",
e AS (SELECT *, {_error()} AS e1, {_error(False)} AS e2, pk % 97 = 0 AND {_error()} = 'CONTRACT_VIOLATION' AS again, off % 4 = 0 AS fixed FROM f),
l AS (
  SELECT *, CASE WHEN again AND fixed AND e2 IS NULL THEN 'replayed' ELSE 'open' END AS status, CASE WHEN again AND fixed AND e2 IS NOT NULL THEN e2 ELSE e1 END AS code
  FROM e WHERE e1 IS NOT NULL)"""
)

_SHOP = (
    _COMMITTED_SILVER
    + f""",
o AS (
  SELECT pk, {_uuid('pk')} AS order_id, CASE WHEN pk % 211 <> 0 THEN {_uuid('o_custkey')} END AS customer_id, o_custkey,
    CASE WHEN pk % 307 = 0 THEN 'LOST' WHEN o_orderstatus = 'F' THEN 'DELIVERED' WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'PAID' END AS status,
    amount, pk % 53 = 0 AS jpy, is_deleted, commit_ms
  FROM s),
lo AS (SELECT * FROM o WHERE NOT is_deleted),
cu AS (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0),
lc AS (SELECT * FROM cu WHERE c_custkey % 19 <> 0),
orph AS (SELECT order_id, customer_id FROM lo WHERE customer_id IS NOT NULL AND commit_ms < 1790000000000 + 400000000 - 300000 AND o_custkey NOT IN (SELECT c_custkey FROM lc))"""
)


def _check(name: str, dataset: str, category: str, severity: str, value: str, threshold: float = 0.0, unit: str = "rows") -> str:
    return f"""SELECT '{name}' AS check_id, '{dataset}' AS dataset, '{category}' AS category, '{severity}' AS severity,
    CASE WHEN x IS NULL THEN 'no_data' WHEN x <= {threshold} THEN 'pass' ELSE 'fail' END AS status, CAST(x AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold, '{unit}' AS unit
  FROM (SELECT {value} AS x)"""


# applied events of the table that were committed in the last hour before the checks ran
_FRESH = "(SELECT quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) FROM k WHERE outcome = 'applied' AND 'shop.orders' = '{}' AND commit_ms >= (SELECT max(commit_ms) FROM k) + 400000 - 3600000)"
# rows committed before the grace, counted from when the checks ran
_OLD_ENOUGH = "commit_ms < (SELECT max(commit_ms) FROM k) + 400000 - 300000"
_CHECKS = _SHOP + ", q AS (" + " UNION ALL ".join([
    _check("orders.primary_key_unique", "orders", "uniqueness", "critical", "(SELECT count(*) - count(DISTINCT pk) FROM o)"),
    _check("orders.required_not_null", "orders", "completeness", "critical", "(SELECT count(*) FROM lo WHERE customer_id IS NULL OR status IS NULL)"),
    _check("orders.status_enum", "orders", "validity", "critical", "(SELECT count(*) FROM lo WHERE status = 'LOST')"),
    _check("orders.currency_enum", "orders", "validity", "critical", "(SELECT count(*) FROM lo WHERE jpy)"),
    _check("orders.channel_enum", "orders", "validity", "critical", "(SELECT count(*) FROM lo WHERE CASE WHEN pk % 13 = 0 THEN 'web' END NOT IN ('web', 'mobile', 'store'))"),
    _check("orders.source_reconciliation", "orders", "reconciliation", "critical", "(SELECT count(*) FROM lo WHERE pk % 401 = 0 OR pk % 503 = 0)"),
    _check("orders.freshness_p95", "orders", "freshness", "warning", _FRESH.format("shop.orders"), 60, "seconds"),
    _check("orders.customer_id_references_customers", "orders", "referential_integrity", "warning", f"(SELECT count(*) FROM lo WHERE customer_id IS NOT NULL AND {_OLD_ENOUGH} AND o_custkey NOT IN (SELECT c_custkey FROM lc))"),
    _check("customers.primary_key_unique", "customers", "uniqueness", "critical", "(SELECT count(*) - count(DISTINCT c_custkey) FROM cu)"),
    _check("customers.required_not_null", "customers", "completeness", "critical", "(SELECT count(*) FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_name IS NULL)"),
    _check("customers.freshness_p95", "customers", "freshness", "warning", _FRESH.format("shop.customers"), 120, "seconds"),
    _check("bronze.event_id_unique", "bronze", "uniqueness", "critical", "(SELECT count(*) - count(DISTINCT eid) FROM f)"),
    _check("dlq.open_records", "dlq", "dead_letters", "warning", "(SELECT count(*) FROM p WHERE outcome = 'stale' AND pk % 2 = 0)"),
]) + ")"

_GRAPH = """
pairs AS (
  SELECT concat('job-', l_orderkey) AS id, l_partkey AS a, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS b
  FROM lineitem),
edges AS (SELECT concat('part-', a) AS src, id AS dst FROM pairs UNION SELECT id, concat('part-', b) FROM pairs)"""



def _pick(cases: dict[int, str], other: str) -> str:
    return "CASE c " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items()) + f" ELSE {other} END"


_CODES = {7: "order_id.required", 8: "status.null", 9: "amount.type", 10: "amount.pattern,amount.decimal", 11: "status.enum", 12: "order_id.format", 13: "created_at.format", 14: "channel.enum", 18: "currency.enum"}
_ORDER_FAULTS = f"""
WITH b AS (SELECT o_orderkey AS k, o_orderkey % 20 AS c, {_pick({12: 'not-a-uuid'}, _uuid('o_orderkey'))} AS id, {_uuid('o_custkey')} AS cust FROM orders),
i AS (SELECT *,
  {_pick({9: '"amount":129.9', 10: '"amount":"12.345"'}, "'\"amount\":\"129.90\"'")} || {_pick({5: ',"channel":null', 6: ',"channel":"web"', 14: ',"channel":"fax"'}, "''")} AS head,
  {_pick({13: '2026-13-45T99:00:00Z'}, "'2026-09-25T10:00:00.5+02:00'")} AS made, {_pick({18: 'JPY'}, "'USD'")} AS currency,
  CASE WHEN c = 7 THEN '' ELSE ',"order_id":"' || id || '"' END || ',"status":' || {_pick({8: 'null', 11: '"LOST"'}, "'\"PAID\"'")} AS tail FROM b),
v AS (SELECT *, '{{' || head || ',"created_at":"' || made || '","currency":"' || currency || '","customer_id":"' || cust || '"' || tail || ',"updated_at":"2026-09-25T10:00:00Z"}}' AS image FROM i),
w AS (SELECT *,
  CASE c WHEN 1 THEN NULL WHEN 2 THEN '[1, 2]' ELSE '{{"before":' || {_pick({4: '3'}, "'null'")} || ',"after":' || image || ',"op":"' || {_pick({19: 'x'}, "'c'")} || '","ts_ms":1790000000005,"source":{{"schema":"shop","table":"' || {_pick({3: 'customers'}, "'orders'")}
    || '","lsn":' || {_pick({15: 'true', 16: '-1'}, 'CAST(k AS VARCHAR)')} || ',"txId":' || {_pick({17: '"7"'}, "'null'")} || ',"ts_ms":1790000000000,"snapshot":"false"}}}}' END AS value,
  CASE c WHEN 5 THEN NULL WHEN 6 THEN '{{"schema":{{}},"payload":{{"order_id":"' || id || '"}}}}' ELSE '{{"order_id":"' || id || '"}}' END AS key,
  CASE WHEN c = 1 THEN 'tombstone' WHEN c IN (0, 5, 6) THEN 'valid' ELSE 'rejected' END AS status,
  {_pick(_CODES, 'NULL')} AS codes FROM v)
SELECT k AS kafka_offset, status,
  CASE WHEN status <> 'rejected' THEN NULL WHEN codes IS NOT NULL THEN 'CONTRACT_VIOLATION' WHEN c = 19 THEN 'UNSUPPORTED_OP' ELSE 'INVALID_ENVELOPE' END AS error_code,
  CASE WHEN status <> 'rejected' THEN NULL WHEN codes IS NOT NULL THEN replace(codes, ',', '; ') WHEN c = 19 THEN 'operation is not applied: x' ELSE 'envelope lacks an object, operation, position or table of the expected form' END AS error_detail,
  CASE WHEN status <> 'tombstone' THEN coalesce(codes, '') END AS violations,
  CASE WHEN status = 'rejected' THEN key END AS raw_key, CASE WHEN status = 'rejected' THEN value END AS raw_value,
  CAST(CASE WHEN status = 'valid' THEN CASE WHEN c = 0 THEN 1 ELSE 2 END END AS INTEGER) AS contract_version, CASE WHEN status = 'valid' THEN id END AS primary_key,
  CASE WHEN status = 'valid' THEN sha256('shop.orders|' || id || '|' || k || '||c|' || sha256('{{"after":' || image || ',"before":null}}')) END AS event_id,
  CASE WHEN status = 'valid' THEN '{{' || head || ',"created_at":"2026-09-25T08:00:00.500000Z","currency":"USD","customer_id":"' || cust || '"' || tail || ',"updated_at":"2026-09-25T10:00:00.000000Z"}}' END AS after_json
FROM w"""


def _hmac(text: str, key: bytes) -> str:
    """Hex HMAC-SHA-256 by its definition over two digests; the key is shorter than a block."""
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_PII_KEY = b"a key of the deployment"
_CUSTOMER_IMAGES = f"""
WITH b AS (SELECT c_custkey AS k, c_custkey % 7 AS c, c_name, {_uuid('c_custkey')} AS id FROM customer),
i AS (SELECT *, {_pick({1: 'nobody'}, "c_name || '@Example.com'")} AS email, {_pick({2: 'de'}, "'DE'")} AS country, CASE c WHEN 3 THEN '' WHEN 4 THEN repeat('n', 201) ELSE c_name END AS full_name,
  {_pick({1: 'email.format', 2: 'country.pattern', 3: 'full_name.min_length', 4: 'full_name.max_length'}, 'NULL')} AS codes FROM b),
v AS (SELECT *, '{{"country":"' || country || '","created_at":"2026-09-25T10:00:00Z","customer_id":"' || id || '","email":"' || email || '","full_name":"' || full_name || '"' || CASE WHEN c = 5 THEN ',"note":"n"' ELSE '' END || ',"updated_at":"2026-09-25T10:00:00Z"}}' AS image FROM i)
SELECT k AS kafka_offset, CASE WHEN codes IS NULL THEN 'valid' ELSE 'rejected' END AS status, CASE WHEN codes IS NOT NULL THEN 'CONTRACT_VIOLATION' END AS error_code, coalesce(codes, '') AS violations,
  CASE WHEN codes IS NULL THEN CASE WHEN c = 5 THEN 'note' ELSE '' END END AS drift_fields, CASE WHEN codes IS NULL THEN id END AS primary_key,
  CASE WHEN codes IS NULL THEN sha256('shop.customers|' || id || '|' || k || '|7|c|' || sha256('{{"after":' || image || ',"before":null}}')) END AS event_id,
  CASE WHEN codes IS NULL THEN '{{"country":"DE","created_at":"2026-09-25T10:00:00.000000Z","customer_id":"' || id || '","email_hmac":"' || {_hmac('lower(email)', _PII_KEY)} || '","updated_at":"2026-09-25T10:00:00.000000Z"}}' END AS after_json,
  CASE WHEN codes IS NULL THEN 1790000000005 END AS debezium_ts_ms
FROM v"""


def _usingkey(edge: str, start: str) -> str:
    src, dst = ("src", "dst") if edge == "down" else ("dst", "src")
    return f"""WITH RECURSIVE {_GRAPH},
reach(id, depth) USING KEY (id) AS (
  SELECT '{start}', 0 UNION
  SELECT e.{dst}, min(r.depth) + 1 FROM reach r JOIN edges e ON e.{src} = r.id LEFT JOIN recurring.reach x ON x.id = e.{dst} WHERE x.id IS NULL GROUP BY e.{dst})"""


_ITER = """
it AS (
  SELECT user_id, count(*) + user_id % 3 AS expected, count(*) AS observed, count(*) FILTER (event_id % 5 = 0) AS dup, count(*) FILTER (event_id % 11 = 0) AS dlq,
    epoch_us(min(ts)) // 1000 AS t0, epoch_us(max(ts)) // 1000 AS t1
  FROM events GROUP BY user_id),
su AS (
  SELECT user_id, observed / greatest((t1 - t0) / 1000.0, 1e-9) AS throughput_eps, greatest(expected - observed, 0) / greatest(expected, 1) AS loss_rate,
    dup / greatest(observed, 1) AS duplicate_rate, dlq / greatest(expected, 1) AS error_rate
  FROM it)"""

_PROBES = """
pr AS (
  SELECT user_id % 7 AS component, ts, event_id AS probe_id,
    CASE WHEN event_id % 13 < 2 THEN 'down' WHEN event_id % 13 = 5 THEN 'degraded' ELSE 'healthy' END AS status
  FROM events)"""

_CURRENCY = "CASE WHEN pk % 53 = 0 THEN 'JPY' WHEN pk % 2 = 0 THEN 'USD' ELSE 'EUR' END"


def _diff(left: str, right: str, on: str, unequal: str) -> str:
    return f"SELECT {on}, CASE WHEN l.here IS NULL THEN 'missing' WHEN r.here IS NULL THEN 'extra' WHEN {unequal} THEN 'different' END AS difference FROM {left} l FULL OUTER JOIN {right} r USING ({on})"


def oracle_sql() -> dict[str, str]:
    start = "1790000000000"
    return {
        "s1_change_feed": f"WITH {_FEED} SELECT eid, pk, op, lsn, ts_ms, part, off, batch, o_custkey, o_orderstatus, CAST(amount AS DOUBLE) AS amount FROM f",
        "p1_first_deliveries": f"WITH {_PLAN} SELECT eid AS event_id, batch AS batch_id, off AS kafka_offset, rn > 1 AS is_repeat FROM d",
        "p3_batch_against_bronze": f"WITH {_PLAN} SELECT eid AS event_id, off AS kafka_offset, outcome AS apply_outcome, coalesce(late, false) AS is_late FROM p WHERE batch = 5",
        "p8_watermarks": f"WITH {_PLAN} SELECT batch AS batch_id, wm AS watermark_ms FROM w WHERE batch IN (SELECT batch FROM d WHERE rn = 1)",
        "p10_history_plan": f"WITH {_PLAN} SELECT eid AS event_id, batch AS batch_id, off AS kafka_offset, outcome AS apply_outcome, coalesce(late, false) AS is_late FROM p",
        "w1_current_rows": f"WITH {_SILVER} SELECT pk AS primary_key, o_custkey, o_orderstatus, CAST(amount AS DOUBLE) AS amount, is_deleted, top AS _source_lsn, prev AS _prev_source_lsn, last_op AS _source_op FROM s",
        "w1_kept_state": f"WITH {_SILVER} SELECT pk AS primary_key, o_custkey, o_orderstatus, CAST(amount AS DOUBLE) AS amount, is_deleted, top AS _source_lsn, prev AS _prev_source_lsn, last_op AS _source_op FROM s",
        "m1_compaction": f"WITH {_PLAN}, g AS (SELECT batch, lsn, CAST(concat('0x', substr(md5(concat_ws('|', eid, pk, lsn, outcome)), 1, 15)) AS BIGINT) AS d FROM p WHERE outcome <> 'duplicate') SELECT batch AS batch_id, count(*) AS row_count, bit_xor(d) AS xor_digest, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM g GROUP BY batch",
        "w4_bronze_append": f"WITH {_FEED} SELECT DISTINCT eid AS event_id, pk AS primary_key, lsn AS source_lsn FROM f WHERE batch = 6 AND eid NOT IN (SELECT eid FROM f WHERE batch < 6)",
        "s7_as_of_batch": f"WITH {_PLAN}, {_fold(chr(40) + 'SELECT * FROM p WHERE outcome = ' + chr(39) + 'applied' + chr(39) + ' AND batch <= 4)')} SELECT pk AS primary_key, CAST(amount AS DOUBLE) AS amount, is_deleted, top AS _source_lsn FROM s",
        "f7_live_rows": f"WITH {_SILVER} SELECT o_orderstatus, count(*) AS live_rows, max(top) AS newest_lsn FROM s WHERE NOT is_deleted GROUP BY 1",
        "r12_revenue": f"WITH {_SILVER} SELECT {_CURRENCY} AS currency, o_orderstatus, count(*) AS order_count, CAST(sum(amount) AS DOUBLE) AS revenue FROM s WHERE NOT is_deleted GROUP BY 1, 2",
        "b2_repair_lost_rows": f"WITH {_SILVER} SELECT pk AS primary_key, o_custkey, o_orderstatus, CAST(amount AS DOUBLE) AS amount, is_deleted, top AS _source_lsn FROM s WHERE pk % 10 = 3",
        "b3_rebuild_new_epoch": f"WITH {_FEED} SELECT CASE WHEN eid IN (SELECT eid FROM f) THEN 'duplicate' WHEN lsn <= (SELECT max(lsn) FROM f AS o WHERE o.pk = f.pk) THEN 'stale' ELSE 'applied' END AS apply_outcome, count(*) AS events FROM f GROUP BY 1",
        "b1_backfill": f"WITH {_PLAN} SELECT CASE WHEN lsn <= t THEN 'stale' ELSE 'applied' END AS apply_outcome, count(*) AS events, min(pk) AS first_key, max(pk) AS last_key FROM (SELECT DISTINCT f.pk, f.lsn, m.t FROM f JOIN (SELECT pk, max(lsn) AS t FROM p WHERE outcome <> 'duplicate' GROUP BY pk) m USING (pk) WHERE op = 'c' AND pk % 20 = 9) GROUP BY 1",
        "d_decode": f"""WITH {_DECODED} SELECT CASE WHEN pk % 67 = 0 THEN 'cdc.shop.unknown' ELSE 'cdc.shop.orders' END AS kafka_topic, CAST(part AS INTEGER) AS kafka_partition, off AS kafka_offset,
            CASE WHEN err IS NULL THEN 'valid' ELSE 'rejected' END AS status, err AS error_code, CASE WHEN err = 'CONTRACT_VIOLATION' THEN {_BROKEN} ELSE '' END AS violations,
            CASE WHEN err IS NULL THEN {_uuid('pk')} END AS primary_key, CASE WHEN err IS NULL THEN op END AS op, CASE WHEN err IS NULL THEN lsn END AS source_lsn, CASE WHEN err IS NULL THEN lsn END AS source_tx_id,
            CASE WHEN err IS NULL THEN ts_ms END AS source_ts_ms, CASE WHEN err IS NULL THEN 'false' END AS source_snapshot, CASE WHEN pk % 67 <> 0 THEN 'orders' END AS contract_name,
            CASE WHEN err IS NULL THEN CAST(CASE WHEN pk % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) END AS contract_version, CASE WHEN err IS NULL THEN CASE WHEN pk % 59 = 0 THEN 'coupon' ELSE '' END END AS drift_fields FROM e""",
        "d18_row_images": f"WITH {_DECODED} SELECT CAST(part AS INTEGER) AS kafka_partition, off AS kafka_offset, CASE WHEN op = 'd' THEN {_IMAGE} END AS before_json, CASE WHEN op <> 'd' THEN {_IMAGE} END AS after_json FROM e WHERE err IS NULL",
        "d21_event_ids": f"WITH {_DECODED} SELECT count(*) AS deliveries, count(DISTINCT sha256(eid)) AS ids, count(DISTINCT (pk, lsn)) AS changes, CAST(min(length(sha256(eid))) AS INTEGER) AS id_length FROM e WHERE err IS NULL",
        "v13_contract_impact": f"""WITH {_IMAGES} SELECT 'orders' AS contract_name, CAST(CASE WHEN pk % 97 = 0 OR pk % 53 = 0 THEN NULL WHEN pk % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS now_version,
            CAST(CASE WHEN pk % 97 = 0 THEN NULL WHEN pk % 53 = 0 THEN 3 WHEN pk % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS then_version, count(*) AS row_count, count(*) FILTER (pk % 97 = 0 AND NOT (pk % 97 = 0 OR pk % 53 = 0)) AS broken,
            count(*) FILTER (pk % 53 = 0 AND pk % 97 <> 0) AS repaired FROM i GROUP BY 1, 2, 3""",
        "v13_open_rejects": f"""WITH {_LETTERS}, t AS (SELECT code, {_error().replace("pk % 97 = 0 OR pk % 53 = 0", "pk % 97 = 0")} AS then_code FROM l WHERE status = 'open')
            SELECT code AS error_code, then_code, count(*) AS records, count(*) FILTER (then_code IS NULL) AS accepted FROM t GROUP BY 1, 2""",
        "v1_image_types": """SELECT o_orderkey % 6 AS form, CAST(NULL AS INTEGER) AS version, CASE WHEN o_orderkey % 6 IN (0, 2) THEN concat_ws(',', 'order_id.required', 'customer_id.required', 'status.required', 'amount.required', 'currency.required', 'created_at.required', 'updated_at.required') ELSE '$.type' END AS violations,
            CASE WHEN o_orderkey % 6 = 2 THEN 'o_orderstatus' ELSE '' END AS drift_fields, count(*) AS images FROM orders GROUP BY ALL""",
        "d15_total_decoding": """WITH v AS (SELECT doc_id, doc_id % 6 AS c, text, CASE doc_id % 6 WHEN 1 THEN concat('{"op":"c","after":', text, '}') WHEN 3 THEN repeat('[', 3000) WHEN 5 THEN '{"op":"c","after":[1],"source":{"schema":"shop","table":"orders","lsn":1,"ts_ms":1}}' WHEN 0 THEN text END AS value FROM documents)
            SELECT doc_id AS kafka_offset, CASE WHEN c = 4 OR text IS NULL AND c <= 2 THEN 'tombstone' ELSE 'rejected' END AS status,
            CASE WHEN c = 4 OR text IS NULL AND c <= 2 THEN NULL WHEN c = 2 THEN 'MALFORMED_ENCODING' WHEN c = 3 THEN 'MALFORMED_JSON' WHEN json_valid(value) THEN 'INVALID_ENVELOPE' ELSE 'MALFORMED_JSON' END AS error_code,
            CASE WHEN c = 4 OR text IS NULL AND c <= 2 THEN NULL WHEN c = 2 THEN md5(concat('base64:', base64(unhex('FF') || encode(text)))) ELSE md5(value) END AS raw_md5, CAST(NULL AS VARCHAR) AS primary_key, CAST(NULL AS VARCHAR) AS event_id FROM v""",
        "v10_classification": f"""WITH {_IMAGES} SELECT CAST(CASE WHEN pk % 97 = 0 OR pk % 53 = 0 THEN NULL WHEN pk % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version, {_BROKEN} AS violations,
            CASE WHEN pk % 59 = 0 THEN 'coupon' ELSE '' END AS drift_fields, count(*) AS images FROM i GROUP BY 1, 2, 3""",
        "r9_versions_seen": f"WITH {_DECODED} SELECT 'orders' AS contract_name, CAST(CASE WHEN pk % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS contract_version, count(*) AS events, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms FROM e WHERE err IS NULL GROUP BY 2",
        "a10_drift_by_field": f"WITH {_DECODED} SELECT 'orders' AS contract_name, 'coupon' AS field, count(*) AS events, max(ts_ms) AS last_seen_ms FROM e WHERE err IS NULL AND pk % 59 = 0 HAVING count(*) > 0",
        "r13_image_diff": f"WITH {_DECODED} SELECT field, count(*) AS changes, count(*) FILTER (op IN ('u', 'd')) AS had_before, count(*) FILTER (op <> 'd') AS had_after FROM e CROSS JOIN (SELECT unnest(['amount', 'channel', 'created_at', 'currency', 'customer_id', 'order_id', 'status', 'updated_at']) AS field) WHERE err IS NULL AND op = 'd' AND (field <> 'channel' OR pk % 13 = 0) GROUP BY field",
        "w6_dead_letters": f"WITH {_LETTERS} SELECT CASE WHEN pk % 67 = 0 THEN 'cdc.shop.unknown' ELSE 'cdc.shop.orders' END AS kafka_topic, CAST(part AS INTEGER) AS kafka_partition, off AS kafka_offset, code AS error_code, status, CAST(CASE WHEN again THEN 1 ELSE 0 END AS BIGINT) AS replay_attempts, CASE WHEN status = 'replayed' THEN CAST(2 AS BIGINT) END AS resolved_batch_id, CAST(1 AS BIGINT) AS batch_id FROM l",
        "a13_open_by_code": f"WITH {_LETTERS} SELECT code AS error_code, count(*) AS open_records FROM l WHERE status = 'open' GROUP BY 1",
        "x5_replay_records": f"""WITH {_LETTERS} SELECT concat('{{"order_id":"', {_uuid('CASE WHEN pk % 83 = 0 THEN pk + 1 ELSE pk END')}, '"}}') AS record_key, 'cdc.replay' AS topic, 'cdc.shop.orders' AS origin FROM (SELECT * FROM l WHERE status = 'open' AND code = 'UNSUPPORTED_OP' ORDER BY off LIMIT 50)""",
        "x5_dry_run": f"WITH {_LETTERS} SELECT 'rejected' AS status, 'CONTRACT_VIOLATION' AS error_code, {_BROKEN} AS violations, CAST(NULL AS INTEGER) AS contract_version, count(*) AS records FROM l WHERE status = 'open' AND code = 'CONTRACT_VIOLATION' GROUP BY 3",
        "r8_rejects": f"WITH {_LETTERS} SELECT off AS kafka_offset, CAST(part AS INTEGER) AS kafka_partition, code AS error_code, status FROM l WHERE status = 'open' ORDER BY off DESC LIMIT 40",
        "r4_rejects_of_key": f"WITH {_LETTERS} SELECT off AS kafka_offset, code AS error_code, status FROM l WHERE instr({_uuid('CASE WHEN pk % 83 = 0 THEN pk + 1 ELSE pk END')}, '00000000970') > 0 ORDER BY off DESC LIMIT 20",
        "a1_batch_profile": f"WITH {_DECODED} SELECT part AS batch_id, count(*) AS input_rows, count(*) FILTER (err IS NULL) AS valid_rows, count(*) FILTER (err IS NOT NULL) AS dlq_rows, CAST(0 AS BIGINT) AS tombstones, min(ts_ms) FILTER (err IS NULL) AS min_source_ts_ms, max(ts_ms) FILTER (err IS NULL) AS max_source_ts_ms, count(DISTINCT pk) FILTER (err IS NULL) AS keys_seen FROM e GROUP BY part",
        "a2_offset_ranges": f"WITH {_FEED} SELECT batch AS batch_id, 'cdc.shop.orders' AS kafka_topic, part AS kafka_partition, min(off) AS from_offset, max(off) AS to_offset, count(*) AS records FROM f GROUP BY batch, part",
        "a3_outcome_counts": f"WITH {_LOG} SELECT batch AS batch_id, applied, superseded, stale, duplicates AS duplicate, late_rows FROM log",
        "a4_freshness": f"WITH {_COMMITTED} SELECT batch AS batch_id, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.5) AS p50, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) AS p95, max((commit_ms - ts_ms) / 1000.0) AS longest, count(*) AS events FROM k WHERE outcome = 'applied' GROUP BY batch",
        "a5_statistics": "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stddev, min(value) AS smallest, max(value) AS largest, count(value) AS samples FROM events GROUP BY event_type",
        "a6_repeated_keys": f"WITH {_FEED} SELECT count(*) - count(DISTINCT eid) AS value FROM f",
        "a8_batch_totals": f"WITH {_LOG} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS input_rows, CAST(coalesce(sum(dlq_rows), 0) AS BIGINT) AS dlq_rows, CAST(coalesce(sum(duplicates), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(applied), 0) AS BIGINT) AS applied, CAST(coalesce(sum(superseded), 0) AS BIGINT) AS superseded, CAST(coalesce(sum(stale), 0) AS BIGINT) AS stale, CAST(coalesce(sum(late_rows), 0) AS BIGINT) AS late_rows, CAST(coalesce(sum(commit_retries), 0) AS BIGINT) AS commit_retries, count(*) AS batches, max(commit_ms) AS last_commit_ms FROM log WHERE commit_ms >= {start} + 2000000",
        "a11_fingerprint": f"WITH {_SILVER}, g AS (SELECT CAST(concat('0x', substr(md5(concat_ws('|', pk, o_orderstatus, amount, is_deleted, top)), 1, 15)) AS BIGINT) AS d FROM s) SELECT count(*) AS row_count, bit_xor(d) AS xor_digest, CAST(CAST(sum(d) AS HUGEINT) AS VARCHAR) AS sum_digest FROM g",
        "a14_consumer_lag": f"WITH {_FEED} SELECT CAST(sum(greatest(e - coalesce(c, 0), 0)) AS BIGINT) AS total_lag, count(*) AS partitions FROM (SELECT part, max(off) + 1 AS e, max(off) FILTER (batch <= 5) + 1 AS c FROM f GROUP BY part)",
        "s12_end_offsets": f"WITH {_FEED} SELECT 'cdc.shop.orders' AS kafka_topic, part AS kafka_partition, max(off) + 1 AS end_offset FROM f GROUP BY part",
        "s11_point_lookup": f"WITH {_FEED} SELECT eid AS event_id, part AS kafka_partition, off AS kafka_offset FROM f WHERE (part, off) IN (SELECT c_custkey % 3, (c_custkey * 10 + 1) * 2 FROM customer)",
        "r1_events": f"WITH {_COMMITTED} SELECT eid AS event_id, lsn AS source_lsn, batch AS batch_id, commit_ms FROM k WHERE op = 'u' AND outcome = 'applied' AND commit_ms >= {start} + 200000000 - 600000000 ORDER BY commit_ms DESC, lsn DESC LIMIT 100",
        "r2_recent_batches": f"WITH {_LOG} SELECT batch AS batch_id, applied, duplicates, commit_ms FROM log ORDER BY commit_ms DESC, batch LIMIT 6",
        "r3_trace": f"""WITH {_PLAN}, {_fold("(SELECT * FROM p WHERE outcome = 'applied' AND pk % 7 <> 0)")},
            keys AS (SELECT DISTINCT c_custkey * 11 AS pk FROM customer),
            h AS (SELECT pk, pk IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) AS src, pk IN (SELECT pk FROM p WHERE outcome <> 'duplicate' AND pk % 7 <> 0) AS cap, pk IN (SELECT pk FROM p WHERE pk % 7 = 0) AS rej,
              pk IN (SELECT pk FROM p WHERE outcome <> 'duplicate' AND pk % 7 <> 0 AND batch <> 3) AS com, pk IN (SELECT pk FROM s) AS lake FROM keys)
            SELECT 'shop.orders' AS source_table, pk AS primary_key, CAST(step AS INTEGER) AS step, ['source', 'capture', 'feed', 'stream', 'commit', 'lake', 'reader'][step + 1] AS stage,
              CASE step WHEN 0 THEN CASE WHEN src OR cap OR rej THEN 'done' ELSE 'pending' END WHEN 1 THEN CASE WHEN cap OR rej THEN 'done' ELSE 'pending' END WHEN 2 THEN CASE WHEN cap OR rej THEN 'done' ELSE 'pending' END
                WHEN 3 THEN CASE WHEN cap THEN 'done' WHEN rej THEN 'failed' ELSE 'pending' END WHEN 4 THEN CASE WHEN com THEN 'done' WHEN rej AND NOT cap THEN 'skipped' ELSE 'pending' END
                WHEN 5 THEN CASE WHEN lake THEN 'done' WHEN rej AND NOT cap THEN 'skipped' ELSE 'pending' END ELSE CASE WHEN lake AND com THEN 'done' WHEN rej AND NOT cap THEN 'skipped' ELSE 'pending' END END AS state
            FROM h CROSS JOIN range(7) t(step)""",
        "r3_evidence": f"""WITH {_COMMITTED_SILVER}{_LETTERS[len(_FEED):]}, keys AS (SELECT DISTINCT c_custkey * 11 AS pk FROM customer),
            x AS (SELECT pk, 'event' AS evidence, commit_ms AS at_ms, lsn AS source_lsn, part AS kafka_partition, off AS kafka_offset, concat(op, ' ', outcome) AS result, (commit_ms - ts_ms) / 1000.0 AS seconds FROM k
              UNION ALL SELECT CASE WHEN pk % 83 = 0 THEN pk + 1 ELSE pk END, 'reject', off, NULL, part, off, concat(code, ' ', status), NULL FROM l WHERE pk % 67 <> 0
              UNION ALL SELECT pk, 'state', commit_ms, top, NULL, NULL, CASE WHEN is_deleted THEN 'deleted' ELSE 'live' END, NULL FROM s)
            SELECT 'shop.orders' AS source_table, pk AS primary_key, evidence, source_lsn, CAST(kafka_partition AS INTEGER) AS kafka_partition, kafka_offset, result, seconds, at_ms FROM x WHERE pk IN (SELECT pk FROM keys)""",
        "r5_overview": f"WITH {_LOG}, o AS (SELECT count(*) AS batches, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(applied) AS BIGINT) AS applied, round(sum(dlq_rows) / sum(n) * 100, 2) AS reject_percent, max(commit_ms) AS last_commit_ms FROM log WHERE commit_ms >= {start} + 20000000 - 1200000000), x AS (SELECT quantile_cont((commit_ms - ts_ms) / 1000.0, 0.5) AS p50, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) AS p95 FROM k WHERE outcome = 'applied' AND commit_ms >= {start} + 20000000 - 1200000000) SELECT * FROM o CROSS JOIN x",
        "r6_sla_status": f"WITH {_COMMITTED}, x AS (SELECT concat('orders-', part) AS dataset, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) AS p95 FROM k WHERE outcome = 'applied' GROUP BY part) SELECT concat('orders-', n_nationkey) AS dataset, n_nationkey * 100 + 60 AS p95_seconds, p95, CASE WHEN p95 IS NULL THEN 'no_data' WHEN p95 <= n_nationkey * 100 + 60 THEN 'met' ELSE 'breached' END AS status FROM nation LEFT JOIN x ON x.dataset = concat('orders-', n_nationkey)",
        "r7_stale_metrics": "SELECT event_type, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 45000000 AS stale FROM events GROUP BY event_type",
        "r10_freshness_series": f"WITH {_COMMITTED} SELECT batch AS batch_id, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.5) AS p50, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) AS p95, max((commit_ms - ts_ms) / 1000.0) AS longest, count(*) AS events FROM k WHERE outcome IN ('applied', 'superseded') GROUP BY batch",
        "r11_dataset_statistics": f"WITH {_COMMITTED_SILVER} SELECT 'orders' AS dataset, count(*) AS row_count, max(commit_ms) AS last_commit_ms FROM s UNION ALL SELECT 'orders_live', count(*), max(commit_ms) FROM s WHERE NOT is_deleted",
        "r14_key_history": f"WITH {_PLAN} SELECT pk AS primary_key, lsn AS source_lsn, off AS kafka_offset, op, outcome AS apply_outcome FROM p WHERE pk IN (SELECT c_custkey FROM customer)",
        "r15_duplicates_absorbed": f"WITH {_LOG} SELECT CAST(sum(duplicates) AS BIGINT) AS duplicates FROM log",
        "r16_newest_live": f"WITH {_COMMITTED_SILVER} SELECT pk AS primary_key, top AS _source_lsn, commit_ms FROM s WHERE NOT is_deleted ORDER BY commit_ms DESC, pk LIMIT 50",
        "r17_newest_events": f"WITH {_COMMITTED} SELECT eid AS event_id, off AS kafka_offset, batch AS batch_id FROM k WHERE pk % 3 <> 0 ORDER BY commit_ms DESC, off DESC, part LIMIT 50",
        "q_checks": f"WITH {_CHECKS} SELECT * FROM q",
        "q5_reconciliation": f"WITH {_SHOP} SELECT order_id, CASE WHEN pk % 401 = 0 THEN 'extra' ELSE 'different' END AS difference FROM lo WHERE pk % 401 = 0 OR pk % 503 = 0",
        "q5_digest_reconciliation": f"WITH {_SHOP} SELECT order_id, CASE WHEN pk % 401 = 0 THEN 'extra' ELSE 'different' END AS difference FROM lo WHERE pk % 401 = 0 OR pk % 503 = 0",
        "q4_orphans": f"WITH {_SHOP} SELECT * FROM orph",
        "q11_verdict": f"WITH {_CHECKS} SELECT count(*) FILTER (status = 'fail' AND severity = 'critical') > 0 AS failed, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail' AND severity = 'critical') AS critical_failures, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (status = 'fail' AND severity = 'warning'), '') AS warnings FROM q",
        "q10_latest_results": "SELECT event_type AS check_id, CAST(event_id AS VARCHAR) AS run_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events) WHERE k = 1",
        "g1_downstream": f"{_usingkey('down', 'part-3')} SELECT id, CAST(depth AS INTEGER) AS depth FROM reach",
        "g2_upstream": f"{_usingkey('up', 'part-5')} SELECT id, CAST(depth AS INTEGER) AS depth FROM reach",
        "g3_impact": f"{_usingkey('down', 'part-3')}, nodes AS (SELECT concat('part-', p_partkey) AS id, p_brand AS owner, 'dataset' AS kind FROM part UNION ALL SELECT DISTINCT id, 'platform', 'job' FROM pairs) SELECT kind, count(*) AS affected, CAST(max(depth) AS INTEGER) AS deepest, array_to_string(list_sort(list(DISTINCT owner)), ',') AS owners FROM reach JOIN nodes USING (id) WHERE depth > 0 GROUP BY kind",
        "g4_integrity": f"""WITH {_GRAPH}, ds AS (SELECT concat('part-', p_partkey) AS id FROM part WHERE concat('part-', p_partkey) NOT LIKE '%77' UNION ALL SELECT concat('part-', p_partkey) FROM part WHERE concat('part-', p_partkey) LIKE '%88' UNION ALL SELECT DISTINCT id FROM pairs WHERE id LIKE '%99'),
            jb AS (SELECT DISTINCT id FROM pairs), both_ AS (SELECT DISTINCT id FROM ds WHERE id IN (SELECT id FROM jb))
            SELECT id, 'duplicate' AS fault FROM (SELECT id FROM ds UNION ALL SELECT id FROM jb) GROUP BY id HAVING count(*) > 1 AND id NOT IN (SELECT id FROM both_)
            UNION ALL SELECT id, 'dataset_and_job' FROM both_
            UNION ALL SELECT id, 'dangling' FROM (SELECT concat('part-', a) AS id FROM pairs UNION SELECT concat('part-', b) FROM pairs) WHERE id NOT IN (SELECT id FROM ds)""",
        "g5_edges": f"WITH {_GRAPH} SELECT src, dst FROM edges",
        "t1_iteration_summary": f"WITH {_ITER} SELECT * FROM su",
        "t2_pooled_latency": "WITH v AS (SELECT value AS x FROM events UNION ALL SELECT value * 2 FROM events) SELECT quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS stddev, min(x) AS smallest, max(x) AS largest, count(x) AS samples FROM v",
        "t3_thresholds": f"WITH {_ITER} SELECT 'max_loss_rate' AS threshold, CAST(0.5 AS DOUBLE) AS \"limit\", coalesce(max(loss_rate) <= 0.5, false) AS passed FROM su UNION ALL SELECT 'min_throughput_eps', 2.0, coalesce(min(throughput_eps) >= 2.0, false) FROM su UNION ALL SELECT 'max_error_rate', 0.0, coalesce(max(error_rate) <= 0.0, false) FROM su",
        "t5_reconcile_workload": f"WITH {_SILVER}, l AS (SELECT pk AS primary_key, o_custkey, o_orderstatus, true AS here FROM s WHERE NOT is_deleted), r AS (SELECT o_orderkey AS primary_key, o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, true AS here FROM orders) SELECT * FROM ({_diff('l', 'r', 'primary_key', 'l.o_custkey IS DISTINCT FROM r.o_custkey OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus')}) WHERE difference IS NOT NULL",
        "t6_compaction_comparison": f"WITH {_SILVER} SELECT true AS same, count(*) AS rows_before, count(*) AS rows_after FROM s",
        "t7_expected_vs_observed": f"WITH {_FEED}, a AS (SELECT o_custkey AS customer, count(*) AS expected FROM orders GROUP BY 1), o AS (SELECT o_custkey AS customer, count(DISTINCT eid) AS observed, count(*) - count(DISTINCT eid) AS repeats FROM f GROUP BY 1), r AS (SELECT o_custkey AS customer, count(*) AS rejects FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1) SELECT customer, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, coalesce(repeats, 0) AS repeats, coalesce(rejects, 0) AS rejects FROM a FULL OUTER JOIN o USING (customer) FULL OUTER JOIN r USING (customer)",
        "n6_status_changes": f"WITH {_PROBES}, x AS (SELECT *, lag(status) OVER (PARTITION BY component ORDER BY ts, probe_id) AS previous FROM pr) SELECT component, probe_id, status, previous FROM x WHERE previous IS NULL OR previous <> status",
        "o9_incidents": f"""WITH {_PROBES}, x AS (SELECT *, status <> 'healthy' AS bad, lag(status) OVER m AS previous, min(CASE WHEN status = 'healthy' THEN ts END) OVER (PARTITION BY component ORDER BY ts, probe_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS healed FROM pr WINDOW m AS (PARTITION BY component ORDER BY ts, probe_id))
            SELECT component, ts AS opened_at, status AS opened_as, healed AS resolved_at FROM x WHERE bad AND (previous IS NULL OR previous = 'healthy')""",
        "o11_overall_status": f"WITH {_PROBES}, x AS (SELECT component, arg_max(status, (ts, probe_id)) AS status FROM pr GROUP BY component) SELECT CASE WHEN count(*) FILTER (status = 'down') > 0 THEN 'down' WHEN count(*) FILTER (status = 'degraded') > 0 THEN 'degraded' WHEN count(*) > 0 THEN 'healthy' ELSE 'unknown' END AS status, count(*) AS components FROM x",
        "o1_alerts": f"""WITH {_LOG}, z AS (SELECT {start} + 20000000 AS t), g AS (SELECT CAST(sum(greatest(e - coalesce(c, 0), 0)) AS BIGINT) AS lag FROM (SELECT part, max(off) + 1 AS e, max(off) FILTER (batch <= 5) + 1 AS c FROM f GROUP BY part)),
            y AS (SELECT (t - max(commit_ms)) / 1000.0 AS idle, sum(dlq_rows) FILTER (commit_ms >= t - 1200000000) AS rejects, sum(commit_retries) FILTER (commit_ms >= t - 1200000000) AS retries FROM log CROSS JOIN z GROUP BY t),
            h AS (SELECT ((SELECT t FROM z) - max(ts_ms)) / 1000.0 AS beat, quantile_cont((commit_ms - ts_ms) / 1000.0, 0.95) FILTER (outcome = 'applied' AND commit_ms >= (SELECT t FROM z) - 1200000000) AS p95 FROM k),
            u AS (SELECT * FROM y CROSS JOIN h CROSS JOIN g)
            SELECT 'stream_stalled' AS alert, CAST(idle AS DOUBLE) AS value, idle > 300 AND lag > 0 AS firing FROM u UNION ALL SELECT 'consumer_lag', lag, lag > 5000 FROM u UNION ALL SELECT 'consumer_lag_degraded', lag, lag > 50000 FROM u
            UNION ALL SELECT 'freshness', p95, p95 > 60 FROM u UNION ALL SELECT 'rejects', rejects, rejects > 0 FROM u UNION ALL SELECT 'commit_retries', retries, retries > 10 FROM u UNION ALL SELECT 'heartbeat', beat, beat > 60 FROM u""",
        "o7_outcome_rates": f"WITH {_PLAN} SELECT ts_ms // 60000 * 60000 AS window_ms, outcome AS apply_outcome, count(*) AS events, count(*) / 60 AS per_second FROM p GROUP BY 1, 2",
        "o8_batch_durations": f"WITH {_LOG} SELECT commit_ms // 300000 * 300000 AS window_ms, quantile_cont(CAST(duration_ms AS DOUBLE), 0.5) AS p50_ms, quantile_cont(CAST(duration_ms AS DOUBLE), 0.95) AS p95_ms, count(*) AS batches FROM log GROUP BY 1",
        "o10_file_sizes": f"WITH {_LOG} SELECT 'orders' AS pipeline, sum(n * 120) / sum(batch + 1) AS bytes_per_file FROM log",
        "o12_replication_lag": "SELECT c_custkey AS slot, c_custkey * c_nationkey * 4000000 AS lag_bytes, c_custkey * c_nationkey * 4000000 > 268435456 AS firing FROM customer",
        "x4_arrival_rate": "SELECT w AS window_ms, count(*) AS events, count(*) / 60 AS per_second FROM (SELECT epoch_us(ts) // 10000000 * 10000 - k * 10000 AS w FROM events CROSS JOIN range(6) t(k)) GROUP BY w",
        "o13_components_down": f"WITH {_PROBES.replace('user_id % 7', 'user_id % 97')}, q AS (SELECT * FROM pr), x AS (SELECT *, lag(status) OVER (PARTITION BY component ORDER BY ts, probe_id) AS previous FROM q), y AS (SELECT component, arg_max(status, (ts, probe_id)) AS status FROM q GROUP BY component), z AS (SELECT component, max(ts) AS since FROM x WHERE previous IS NULL OR previous <> status GROUP BY component) SELECT component, status, since FROM y JOIN z USING (component) WHERE status <> 'healthy' AND since <= (SELECT max(ts) FROM events) - INTERVAL 1 SECOND",
        "w7_batch_attempts": "SELECT event_type AS pipeline, user_id AS batch_id, event_id AS attempt_id, attempts, value FROM (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS attempts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "r18_benchmark_runs": f"WITH {_ITER} SELECT user_id, t1 AS last_commit_ms, loss_rate, loss_rate <= 0.01 AND error_rate <= 0.1 AS within FROM su JOIN it USING (user_id) ORDER BY t1 DESC, user_id LIMIT 20",
        "s17_live_tap": f"WITH {_FEED} SELECT CAST(part AS INTEGER) AS kafka_partition, off AS kafka_offset, CASE WHEN pk % 73 = 0 OR pk % 101 = 0 THEN NULL WHEN pk % 89 = 0 THEN 't' ELSE op END AS op, CASE WHEN pk % 73 <> 0 AND pk % 101 <> 0 THEN lsn END AS lsn, pk % 73 = 0 OR pk % 101 = 0 AS malformed, false AS tombstone FROM f",
        "d2_order_faults": _ORDER_FAULTS,
        "d19_customer_images": _CUSTOMER_IMAGES,
        "d19_pseudonyms": f"SELECT c_custkey, {_hmac('lower(trim(c_name))', _PII_KEY)} AS pseudonym FROM customer",
        "k14_lsn_text": "SELECT o_orderkey, o_orderkey * 987654321 AS lsn, concat(printf('%X', (o_orderkey * 987654321) >> 32), '/', printf('%X', (o_orderkey * 987654321) & 4294967295)) AS lsn_text, o_orderkey * 987654321 AS lsn_back FROM orders",
        "k13_raw_bytes": """WITH b AS (SELECT o_orderkey, encode(concat(o_orderkey, ' ä', o_orderstatus)) AS own FROM orders), v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN NULL WHEN o_orderkey % 3 = 0 THEN unhex('FFC3') || own ELSE own END AS data FROM b)
            SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('base64:', base64(data)) ELSE decode(CASE WHEN o_orderkey % 3 <> 0 THEN data END) END AS kept, hex(data) AS back FROM v WHERE data IS NOT NULL UNION ALL SELECT o_orderkey, NULL, NULL FROM v WHERE data IS NULL""",
        "k6_struct_of_texts": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderstatus END AS status, CAST(NULL AS VARCHAR) AS absent FROM orders",
        "k7_json_values": "SELECT event_id, json_extract_string(j, '$.k') AS k, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k_number, json_extract_string(j, '$.none') AS none FROM (SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN CAST(props AS JSON) END AS j FROM events)",
        "k3_positions": f"WITH {_FEED} SELECT eid AS event_id, off AS kafka_offset, concat(lpad(CAST(part AS VARCHAR), 5, '0'), ':', lpad(CAST(off AS VARCHAR), 20, '0')) AS position, sha256(concat('shop.orders|', pk, '|', lsn)) AS digest FROM f",
        "k12_times": "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.123456Z') AS utc, epoch_ms(date_trunc('second', o_orderdate)) - 7200000 + 123 AS ms FROM orders",
    }
