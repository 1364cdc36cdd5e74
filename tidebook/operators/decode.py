"""Decode change envelopes: one set-based projection that names the first rule a record breaks and never fails a batch."""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.scalars import PIPE, any_of, ended_json, header, is_int, is_null, is_whole, kind, member, members, only_texts, parse_rfc3339, pseudonym, sha256_text, text_of, text_or_base64, utc_text
from tidebook.plans.contracts import Field, Registry, classify
from tidebook.sources.staging import staged

# Operations that are applied, and headers of replayed or injected records.
OPS = ("c", "u", "d", "r")
ORIGINAL_TOPIC, REPLAY_OF, INJECTION_ID = "original-topic", "replay-of", "injection-id"
DETAIL_LENGTH = 1000
# What is read of an envelope, taken out in one walk; the source is null unless it is an object.
_ENVELOPE = "struct<op:variant,ts_ms:variant,`before`:variant,`after`:variant,source:struct<`schema`:string,`table`:string,lsn:variant,ts_ms:variant,txId:variant,snapshot:string>>"

DECODED = [
    "status", "error_code", "error_detail", "violations", "raw_key", "raw_value", "source_table", "contract_name", "contract_version",
    "drift_fields", "op", "primary_key", "source_lsn", "source_tx_id", "source_ts_ms", "source_snapshot", "debezium_ts_ms",
    "before_json", "after_json", "event_id",
]


def _by_contract(registry: Registry, make) -> Column:
    out = None
    for n in registry.names:
        out = F.when(F.col("contract_name") == n, make(n)) if out is None else out.when(F.col("contract_name") == n, make(n))
    return out


def _bad_timestamp(image: Column, fields: list[Field]) -> Column:
    """Of an image's members: whether one is a text that should be a time and can't be read."""
    bad = F.lit(False)
    for f in fields:
        if f.format == "date-time" and f.column:
            # what isn't JSON text stays as it is, so only a text that can't be read is bad
            v = member(image, f.name)
            bad = bad | F.coalesce((v["kind"] == "STRING") & parse_rfc3339(v["text"]).isNull(), F.lit(False))
    return bad


def _normalised(image: Column, taken: Column, fields: list[Field], pii_key: bytes) -> Column:
    """Canonical JSON of the known members that are present: keys sorted, times in UTC, personal data hashed or dropped.

    ``taken`` has the members of the variant ``image``.  Where all of them are strings their texts are written: a variant makes
    a JSON writer of its own for every text in it.
    """
    variants = F.try_variant_get(image, "$", "map<string,variant>")
    plain, other = [], []
    for f in sorted((f for f in fields if f.column), key=lambda f: f.column):
        v, m = member(variants, f.name), member(taken, f.name)
        text, value = m["text"], v
        if f.format == "date-time":
            text = utc_text(parse_rfc3339(text))
            value = F.when(m["kind"] == "STRING", text.cast("variant")).otherwise(v)
        if f.pii == "hash":
            text = pseudonym(m["text"], pii_key)
            value = F.when(m["kind"] == "VOID", v).otherwise(text.cast("variant"))
        plain.append(text.alias(f.column))
        other.append(value.alias(f.column))
    return F.when(only_texts(taken), F.to_json(F.struct(*plain), {"ignoreNullFields": "true"})).otherwise(F.to_json(F.struct(*other), {"ignoreNullFields": "true"}))


def _key_fits(registry: Registry, name: str) -> Column:
    fits = F.col("_key").isNotNull()
    for k in registry.current(name).key:
        fits = fits & F.coalesce(F.try_element_at(F.col("_key"), F.lit(k)) == member(F.col("_row"), k)["text"], F.lit(False))
    return F.col("key").isNull() | fits


@contextlib.contextmanager
def small_methods(spark: SparkSession):
    """Plans made in here have no whole-stage code.  The decoding projection is longer than a method that the JIT compiles, so
    it would run interpreted there; on its own it is split into small methods and takes about half the time."""
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)


def decoded_table(feed: DataFrame, registry: Registry, pii_key: bytes, name: str = "decoded", columns: Sequence[str] | None = None) -> DataFrame:
    """The decoded feed, written once: several columns of a decoded row are read by what follows.

    ``columns`` names those that are read: images, digests and texts that nobody reads are not made.  Filter what is returned: a
    filter inside the decoding plan makes the optimizer expand its constraints for minutes.
    """
    with small_methods(feed.sparkSession):
        rows = decode(feed, registry, pii_key)
        return staged(rows if columns is None else rows.select(*columns), name)


def decode(feed: DataFrame, registry: Registry, pii_key: bytes) -> DataFrame:
    """The feed's Kafka columns with replay headers and the decoded columns.

    Text after the value, duplicate keys inside an object, and numbers beyond JSON (NaN, Infinity), make a value malformed JSON.
    """
    topics = F.create_map(*[x for n in registry.names for x in (F.lit(registry.current(n).topic), F.lit(n))])
    rows = feed.withColumns({
        "source_topic": F.coalesce(header(F.col("headers"), ORIGINAL_TOPIC), F.col("topic")),
        "replay_of": header(F.col("headers"), REPLAY_OF),
        "injection_id": header(F.col("headers"), INJECTION_ID),
        "_utf8": F.is_valid_utf8(F.col("value").cast("string")),
    })
    rows = rows.withColumns({
        "contract_name": F.try_element_at(topics, F.col("source_topic")),
        "_ended": F.when(F.col("_utf8"), ended_json(F.col("value").cast("string"))),
        "_key_ended": F.when(F.is_valid_utf8(F.col("key").cast("string")), ended_json(F.col("key").cast("string"))),
    })
    whole, key_whole = is_whole(F.col("_ended")), is_whole(F.col("_key_ended"))
    rows = rows.withColumns({
        "_json": whole,
        "_env": F.when(whole, F.try_variant_get("_ended", "$[0]", _ENVELOPE)),
        "_wrap": F.when(key_whole, F.try_variant_get("_key_ended", "$[0]", "struct<payload:variant,`schema`:variant>")),
    })
    env, wrap, texts = F.col("_env"), F.col("_wrap"), "map<string,string>"
    wrapped = wrap["payload"].isNotNull() & wrap["schema"].isNotNull()
    source, sent, before, after = env["source"], env["ts_ms"], env["before"], env["after"]
    number = lambda v: F.try_variant_get(v, "$", "bigint")
    lsn, ts, tx = source["lsn"], source["ts_ms"], source["txId"]
    # each variant holds the names of the whole document, so none but the images goes on from here
    rows = rows.withColumns({
        "_key": F.when(wrapped, F.try_variant_get(wrap["payload"], "$", texts)).when(wrap.isNotNull(), F.try_variant_get("_key_ended", "$[0]", texts)),
        "_op": F.when(kind(env["op"]) == "STRING", text_of(env["op"])),
        "_sent": F.when(is_int(sent), number(sent)),
        "_before": before,
        "_after": after,
        "_before_members": members(before),
        "_after_members": members(after),
        "_before_held": before.isNotNull() & ~F.is_variant_null(before),
        "_after_held": after.isNotNull() & ~F.is_variant_null(after),
        "_env_object": env.isNotNull(),
        "_lsn": F.when(is_int(lsn), number(lsn)),
        "_ts": F.when(is_int(ts), number(ts)),
        "_tx": number(tx),
        "_tx_fits": is_null(tx) | is_int(tx),
        "_snapshot": source["snapshot"],
        "_source_object": source.isNotNull(),
        "_table": F.concat_ws(".", F.coalesce(source["schema"], F.lit("None")), F.coalesce(source["table"], F.lit("None"))),
    })
    deleted = F.col("_op") == "d"
    rows = rows.withColumns({
        "source_table": _by_contract(registry, lambda n: F.lit(registry.current(n).table)),
        "_row": F.when(deleted, F.col("_before_members")).otherwise(F.col("_after_members")),
        "_other": F.when(deleted, F.col("_after_members")).otherwise(F.col("_before_members")),
        "_no_row": ~F.when(deleted, F.col("_before_held")).otherwise(F.col("_after_held")),
        "_odd_image": any_of(*[F.col(f"{c}_held") & F.col(f"{c}_members").isNull() for c in ("_before", "_after")]),
    })
    rows = classify(rows, "_row", "contract_name", registry, "_")
    bad = lambda name: _by_contract(registry, lambda n: _bad_timestamp(F.col(name), registry.fields(n)))
    # the row's own image was accepted, so its times are read again only where some version doesn't hold them to a format
    loose = lambda n: [f for f in registry.fields(n) if any(g.name == f.name and g.format != "date-time" for c in registry.active(n) for g in c.fields)]
    bad_loose = _by_contract(registry, lambda n: _bad_timestamp(F.col("_row"), loose(n)))
    error = (
        F.when(F.col("value").isNull(), None)
        .when(F.col("contract_name").isNull(), "UNKNOWN_TOPIC")
        .when(~F.col("_utf8"), "MALFORMED_ENCODING")
        .when(~F.col("_json"), "MALFORMED_JSON")
        .when(~F.col("_env_object") | F.col("_op").isNull(), "INVALID_ENVELOPE")
        .when(~F.col("_op").isin(*OPS), "UNSUPPORTED_OP")
        .when(~F.col("_source_object"), "INVALID_ENVELOPE")
        .when(F.col("_lsn").isNull() | (F.col("_lsn") < 0) | F.col("_ts").isNull() | ~F.col("_tx_fits"), "INVALID_ENVELOPE")
        .when(F.col("_table") != F.col("source_table"), "INVALID_ENVELOPE")
        .when(F.col("_odd_image"), "INVALID_ENVELOPE")
        .when(F.col("_no_row"), "MISSING_ROW_IMAGE")
        .when(F.col("_version").isNull(), "CONTRACT_VIOLATION")
        .when(~_by_contract(registry, lambda n: _key_fits(registry, n)), "KEY_MISMATCH")
        .when((F.col("_other").isNotNull() & bad("_other")) | bad_loose, "MALFORMED_ROW_IMAGE")
    )
    # rand() keeps the optimizer from copying the whole decision into every filter above it
    rows = rows.withColumn("error_code", F.when(F.rand() < 2, error))
    code = F.col("error_code")
    rows = rows.withColumn("status", F.when(F.col("value").isNull(), "tombstone").when(code.isNotNull(), "rejected").otherwise("valid"))
    valid = F.col("status") == "valid"
    pk = _by_contract(registry, lambda n: F.concat_ws(PIPE, *[member(F.col("_row"), k)["text"] for k in registry.current(n).key]))
    image_texts = lambda c: F.transform_values(f"{c}_members", lambda _, m: m["text"])
    json = lambda c: F.coalesce(F.when(only_texts(F.col(f"{c}_members")), F.to_json(image_texts(c))).otherwise(F.to_json(F.col(c))), F.lit("null"))
    row_hash = F.sha2(F.concat(F.lit('{"after":'), json("_after"), F.lit(',"before":'), json("_before"), F.lit("}")), 256)
    detail = {
        "UNKNOWN_TOPIC": F.concat(F.lit("no contract for topic "), F.col("source_topic")),
        "MALFORMED_ENCODING": F.lit("value is not UTF-8"),
        "MALFORMED_JSON": F.lit("value is not JSON"),
        "INVALID_ENVELOPE": F.lit("envelope lacks an object, operation, position or table of the expected form"),
        "UNSUPPORTED_OP": F.concat(F.lit("operation is not applied: "), F.col("_op")),
        "MISSING_ROW_IMAGE": F.concat(F.lit("operation lacks its row image: "), F.col("_op")),
        "CONTRACT_VIOLATION": F.array_join(F.col("_violations"), "; "),
        "KEY_MISMATCH": F.lit("record key does not match the row's primary key"),
        "MALFORMED_ROW_IMAGE": F.lit("a row image has a time that cannot be read"),
    }
    text = None
    for k, v in detail.items():
        text = F.when(code == k, v) if text is None else text.when(code == k, v)
    rejected = F.col("status") == "rejected"
    rows = rows.withColumns({
        "error_detail": F.substr(text, F.lit(1), F.lit(DETAIL_LENGTH)),
        "violations": F.when(code == "CONTRACT_VIOLATION", F.col("_violations")).when(rejected | valid, F.array().cast("array<string>")),
        "raw_key": F.when(rejected, text_or_base64(F.col("key"))),
        "raw_value": F.when(rejected, text_or_base64(F.col("value"))),
        "contract_name": F.when(F.col("status") != "tombstone", F.col("contract_name")),
        "source_table": F.when(F.col("status") != "tombstone", F.col("source_table")),
        "contract_version": F.when(valid, F.col("_version")),
        "drift_fields": F.when(valid, F.col("_drift_fields")),
        "op": F.when(valid, F.col("_op")),
        "primary_key": F.when(valid, pk),
        "source_lsn": F.when(valid, F.col("_lsn")),
        "source_tx_id": F.when(valid, F.col("_tx")),
        "source_ts_ms": F.when(valid, F.col("_ts")),
        "source_snapshot": F.when(valid, F.lower("_snapshot")),
        "debezium_ts_ms": F.when(valid, F.col("_sent")),
        "before_json": F.when(valid & F.col("_before_members").isNotNull(), _by_contract(registry, lambda n: _normalised(F.col("_before"), F.col("_before_members"), registry.fields(n), pii_key))),
        "after_json": F.when(valid & F.col("_after_members").isNotNull(), _by_contract(registry, lambda n: _normalised(F.col("_after"), F.col("_after_members"), registry.fields(n), pii_key))),
        "_hash": F.when(valid, row_hash),
    })
    rows = rows.withColumn("event_id", F.when(valid, sha256_text(*[F.col(c) for c in ("source_table", "primary_key", "source_lsn", "source_tx_id", "op", "_hash")])))
    kafka = [F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts")]
    return rows.select(*kafka, "source_topic", "replay_of", "injection_id", *DECODED)
