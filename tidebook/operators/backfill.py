"""Backfill: source rows re-read and sent through the normal path as snapshot reads, which can't overtake newer rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.plans.contracts import Contract

KEY_LIMIT = 500


def select_rows(source: DataFrame, key: str | None = None, keys: list[str] | None = None, since: dt.datetime | None = None, updated: str = "updated_at", where: Column | None = None) -> DataFrame:
    """Source rows of some keys (at most 500, lower-cased) and/or changed since a time with a zone; one of them is needed."""
    if keys is None and since is None and where is None:
        raise ValueError("name keys or a time")
    rows = source
    if keys is not None:
        if len(keys) > KEY_LIMIT:
            raise ValueError(f"at most {KEY_LIMIT} keys at a time")
        rows = rows.where(F.lower(key).isin([k.lower() for k in keys]))
    if since is not None:
        if since.tzinfo is None:
            raise ValueError("the time needs a zone")
        rows = rows.where(F.col(updated) >= F.lit(since))
    return rows if where is None else rows.where(where)


def as_envelopes(rows: DataFrame, contract: Contract, lsn: Column, ts_ms: Column, topic: str) -> DataFrame:
    """Source rows of a contract's table as Kafka records of ``op = r``, ready for decoding."""
    schema, table = contract.table.split(".")
    fields = []
    for f in contract.fields:
        value = F.col(f.name)
        if f.format == "date-time":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif f.type == "string":
            value = value.cast("string")
        fields.append(value.alias(f.name))
    source = F.struct(F.lit(schema).alias("schema"), F.lit(table).alias("table"), lsn.cast("long").alias("lsn"), F.lit(None).cast("long").alias("txId"), ts_ms.cast("long").alias("ts_ms"), F.lit("backfill").alias("snapshot"))
    body = F.to_json(F.struct(F.lit(None).cast("string").alias("before"), F.struct(*fields).alias("after"), F.lit("r").alias("op"), ts_ms.cast("long").alias("ts_ms"), source.alias("source")), {"ignoreNullFields": "false"})
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in contract.key]))
    headers = F.array().cast("array<struct<key:string,value:binary>>")
    return rows.select(
        F.encode(key, "UTF-8").alias("key"), F.encode(body, "UTF-8").alias("value"), F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"), F.timestamp_millis(ts_ms.cast("long")).alias("timestamp"), F.lit(0).alias("timestampType"), headers.alias("headers"),
    )
