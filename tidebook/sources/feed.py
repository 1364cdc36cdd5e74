"""Change feeds: the shape of a Kafka source, and a deterministic feed derived from the ``orders`` table.

The derived feed inserts every order, updates and deletes some, redelivers some events, and lets some arrive batches late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KAFKA_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
])

BATCHES = 8
START_MS = 1_790_000_000_000


def read_changes(spark: SparkSession, path: str | None = None, topics: list[str] | None = None, starting: str = "earliest", max_per_trigger: int = 20_000, servers: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A streaming change feed: Kafka where a broker is named, else Parquet files of the Kafka schema."""
    if servers:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics or []))
        reader = reader.option("startingOffsets", starting).option("includeHeaders", "true").option("maxOffsetsPerTrigger", max_per_trigger)
        return reader.option("failOnDataLoss", "true").load()
    return spark.readStream.schema(KAFKA_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def derived_changes(orders: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """eid, pk, op, lsn, ts_ms, part, off, batch, o_custkey, o_orderstatus, amount: two to six deliveries an order.

    Everything follows from the order's key by arithmetic, so a task needs nothing but its own rows and the row count.
    ``dealt`` may give the same rows in other partitions: they are dealt before each of them becomes several.
    """
    n = orders.agg(F.count("*").alias("n")).scalar()
    pk = F.col("o_orderkey")
    version = F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("v")
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("r")
    rows = (orders if dealt is None else dealt).select("*", version).select("*", again).withColumn("_n", n)
    kept = (F.col("v") == 1) | ((F.col("v") == 2) & (pk % 10 < 6)) | ((F.col("v") == 3) & (pk % 10).isin(1, 9))
    rows = rows.where(kept & ((F.col("r") == 0) | ((pk + F.col("v")) % 7 == 0)))
    delay = F.when((pk + F.col("v")) % 11 == 0, 2).when((F.col("v") == 2) & (pk % 4 == 1), 1).otherwise(0)
    return rows.select(
        F.concat(F.lit("o"), pk.cast("string"), F.lit("-"), F.col("v").cast("string")).alias("eid"),
        pk.alias("pk"),
        F.when(F.col("v") == 1, "c").when(F.col("v") == 3, "d").otherwise("u").alias("op"),
        (pk * 10 + F.col("v")).alias("lsn"),
        (F.lit(START_MS) + (pk * 10 + F.col("v")) * 100).alias("ts_ms"),
        (pk % 3).alias("part"),
        ((pk * 10 + F.col("v")) * 2 + F.col("r")).alias("off"),
        (F.floor(pk * BATCHES / F.col("_n")) + delay + F.col("r")).cast("long").alias("batch"),
        "o_custkey",
        "o_orderstatus",
        (F.col("o_totalprice") + F.col("v")).cast("decimal(12,2)").alias("amount"),
    )


def as_events(changes: DataFrame) -> DataFrame:
    """The derived feed in the planner's columns; the data columns keep their names."""
    return changes.select(
        F.col("eid").alias("event_id"),
        F.lit("shop.orders").alias("source_table"),
        F.col("pk").alias("primary_key"),
        "op",
        F.col("lsn").alias("source_lsn"),
        F.col("ts_ms").alias("source_ts_ms"),
        F.lit("cdc.shop.orders").alias("kafka_topic"),
        F.col("part").alias("kafka_partition"),
        F.col("off").alias("kafka_offset"),
        F.col("batch").alias("batch_id"),
        "o_custkey",
        "o_orderstatus",
        "amount",
    )


STATES = {"F": "DELIVERED", "O": "PENDING", "P": "PAID"}


def order_uuid(key):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(key.cast("string"), 12, "0"))


def as_envelopes(changes: DataFrame) -> DataFrame:
    """The derived feed as Kafka records with the envelope of a change connector.

    Some records are broken, by their key: every 97th has a negative amount, 101st truncated JSON, 89th an unknown
    operation, 83rd a key that doesn't match, 79th a position as text, 73rd bytes that are no UTF-8, 71st no row image,
    67th an unknown topic, 61st a bad time in the image that isn't validated; every 59th has a field no contract knows,
    every 53rd has a currency that only the proposed contract
    takes, every 13th uses the newer contract's channel.
    """
    pk = F.col("pk")
    every = lambda m: pk % m == 0
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("o_orderstatus")), F.lit("SHIPPED"))
    at = F.col("_at")

    def image(time):
        text = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
        amount = F.when(every(97), F.lit("-5.00")).otherwise(F.col("amount").cast("string"))
        parts = [
            text("order_id", order_uuid(pk)),
            text("customer_id", order_uuid(F.col("o_custkey"))),
            text("status", state),
            text("amount", amount),
            text("currency", F.when(every(53), "JPY").when(pk % 2 == 0, "USD").otherwise("EUR")),
            F.when(every(13), text("channel", F.lit("web"))),
            F.when(every(59), text("coupon", F.lit("X1"))),
            text("created_at", at),
            text("updated_at", time),
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    changes = changes.withColumn("_at", F.date_format(F.timestamp_millis(F.col("ts_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("_image", image(at))
    null = F.lit("null")
    before = F.when(F.col("op") == "d", F.col("_image")).when((F.col("op") == "u") & every(61), image(F.lit("yesterday"))).otherwise(null)
    after = F.when(F.col("op") == "d", null).otherwise(F.col("_image"))
    before, after = (F.when(every(71), null).otherwise(x) for x in (before, after))
    op = F.when(every(89), "t").otherwise(F.col("op"))
    lsn = F.when(every(79), F.concat(F.lit('"'), F.col("lsn"), F.lit('"'))).otherwise(F.col("lsn").cast("string"))
    body = F.concat(
        F.lit('{"before":'), before, F.lit(',"after":'), after, F.lit(',"op":"'), op, F.lit('","ts_ms":'), F.col("ts_ms"),
        F.lit(',"source":{"schema":"shop","table":"orders","lsn":'), lsn, F.lit(',"txId":'), F.col("lsn"), F.lit(',"ts_ms":'), F.col("ts_ms"), F.lit(',"snapshot":"false"}}'),
    )
    body = F.when(every(101), F.substr(body, F.lit(1), F.lit(40))).otherwise(body)
    value = F.when(every(73), F.unhex(F.lit("FFFEFD"))).otherwise(body.cast("binary"))
    key = F.concat(F.lit('{"order_id":"'), order_uuid(F.when(every(83), pk + 1).otherwise(pk)), F.lit('"}'))
    return changes.select(
        key.cast("binary").alias("key"),
        value.alias("value"),
        F.when(every(67), "cdc.shop.unknown").otherwise("cdc.shop.orders").alias("topic"),
        F.col("part").cast("int").alias("partition"),
        F.col("off").alias("offset"),
        F.timestamp_millis(F.col("ts_ms") + 250).alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.array().cast(KAFKA_SCHEMA["headers"].dataType).alias("headers"),
    )
