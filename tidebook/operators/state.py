"""Current row state as a fold over applied events: no merge, one aggregation by key.

The newest applied event of a key decides whether the row is deleted; its data come from the newest event that carries a row,
or, for a key seen only deleted, from the first delete's before image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.planner import APPLIED
from tidebook.plans.contracts import Field, Registry

KEY = ("source_table", "primary_key")
META = ["is_deleted", "deleted_at", "_source_lsn", "_prev_source_lsn", "_source_ts", "_source_op", "_event_id", "_contract_version", "_batch_id", "_stream_epoch", "_ingested_at"]


def fold(events: DataFrame, data: list[str], key: tuple[str, ...] = KEY, only_applied: bool = True) -> DataFrame:
    """One row for each key: its data columns, is_deleted, _source_lsn, _prev_source_lsn, _source_op, and the newest event's
    other columns where the events have them (event_id, source_ts, contract_version, batch_id, stream_epoch, committed_at).

    Planned events carry their predecessor's position, so all of it is one aggregation, partial before the shuffle; events
    without ``previous_lsn`` get it from a window by key."""
    rows = events.where(F.col("apply_outcome") == APPLIED) if only_applied else events
    lsn = F.col("source_lsn")
    if "previous_lsn" not in rows.columns:
        rows = rows.withColumn("previous_lsn", F.lag("source_lsn").over(Window.partitionBy(*key).orderBy("source_lsn")))
    deleted = F.col("op") == "d"
    image = F.struct(*data)
    carried = {"event_id": "_event_id", "source_ts": "_source_ts", "contract_version": "_contract_version", "batch_id": "_batch_id", "stream_epoch": "_stream_epoch", "committed_at": "_ingested_at"}
    last = F.max_by(F.struct("op", *[c for c in carried if c in events.columns]), lsn)
    folded = rows.groupBy(*key).agg(
        F.coalesce(F.max_by(F.when(~deleted, image), F.when(~deleted, lsn)), F.min_by(F.when(deleted, image), F.when(deleted, lsn))).alias("_data"),
        last.alias("_last"),
        F.max(lsn).alias("_source_lsn"),
        F.max_by("previous_lsn", lsn).alias("_prev_source_lsn"),
    )
    out = folded.select(*key, *[F.col(f"_data.{c}").alias(c) for c in data], (F.col("_last.op") == "d").alias("is_deleted"), "_source_lsn", "_prev_source_lsn", F.col("_last.op").alias("_source_op"), *[F.col(f"_last.{c}").alias(a) for c, a in carried.items() if c in events.columns])
    if "_source_ts" in out.columns:
        out = out.withColumn("deleted_at", F.when(F.col("is_deleted"), F.col("_source_ts")))
    return out


def typed(json: Column, fields: list[Field]) -> list[Column]:
    """Contract columns of a canonical row image."""
    row = F.from_json(json, T.StructType([T.StructField(f.column, T.StringType()) for f in fields]))
    return [row[f.column].try_cast(f.column_type).alias(f.column) for f in fields]


def state_rows(events: DataFrame) -> DataFrame:
    """Rows of the kept state, from all of the keys' bronze events."""
    image = F.when(F.col("op") == "d", F.col("before_json")).otherwise(F.col("after_json"))
    return fold(events.withColumns({"image_json": image, "is_row": F.col("op") != "d"}), ["image_json", "is_row"]).select(*KEY, "image_json", "is_row", *META)


def merge_state(kept: DataFrame, applied: DataFrame) -> DataFrame:
    """The kept state after one more batch: ``applied`` has at most one applied event a key, none of them older than the key's row.

    A delete keeps the row's image; that of a key that was never seen alive is its first delete's before image."""
    carried = {"event_id": "_event_id", "source_ts": "_source_ts", "contract_version": "_contract_version", "batch_id": "_batch_id", "stream_epoch": "_stream_epoch", "committed_at": "_ingested_at", "op": "_source_op", "source_lsn": "_source_lsn", "previous_lsn": "_prev_source_lsn"}
    new = applied.select(*KEY, F.struct("before_json", "after_json", *[F.col(c).alias(a) for c, a in carried.items()]).alias("n"))
    old = kept.select(*KEY, F.struct(*[c for c in kept.columns if c not in KEY]).alias("o"))
    both = old.join(new, list(KEY), "full")
    n, o = F.col("n"), F.col("o")
    changed, deleted = n.isNotNull() & (o.isNull() | (n["_source_lsn"] >= o["_source_lsn"])), n["_source_op"] == "d"
    value = {
        "image_json": F.when(~deleted, n["after_json"]).when(o.isNull(), n["before_json"]).otherwise(o["image_json"]), "is_row": ~deleted | F.coalesce(o["is_row"], F.lit(False)),
        "is_deleted": deleted, "deleted_at": F.when(deleted, n["_source_ts"]),
    } | {a: n[a] for a in carried.values()}
    return both.select(*KEY, *[F.when(changed, value[c]).otherwise(o[c]).alias(c) for c in ("image_json", "is_row", *META)])


def kept_rows(kept: DataFrame, registry: Registry, contract: str, stored: dict[str, str] | None = None) -> DataFrame:
    """The current-state table of one contract from the kept state; equal to ``current_rows`` of all bronze events.

    ``stored``: the contract's columns as the lake's snapshot has them (``columns``), which may be more than those of the
    registry; rows written before a column came have null there."""
    mine = kept.where(F.col("source_table") == registry.current(contract).table)
    if stored is None:
        return mine.select("primary_key", *typed(F.col("image_json"), registry.columns(contract)), *META)
    image = F.from_json("image_json", T.StructType([T.StructField(c, T.StringType()) for c in stored]))
    return mine.select("primary_key", *[image[c].try_cast(kind).alias(c) for c, kind in stored.items()], *META)


def current_rows(bronze: DataFrame, registry: Registry, contract: str) -> DataFrame:
    """The current-state table of one contract from its bronze events."""
    fields = registry.columns(contract)
    mine = bronze.where(F.col("source_table") == registry.current(contract).table)
    image = F.when(F.col("op") == "d", F.col("before_json")).otherwise(F.col("after_json"))
    rows = fold(mine.withColumn("image_json", image), ["image_json"])
    return rows.select("primary_key", *typed(F.col("image_json"), fields), *[c for c in META if c in rows.columns])


def as_of(events: DataFrame, batch_id: int) -> DataFrame:
    """The events committed up to a batch: fold them for the state at that point."""
    return events.where(F.col("batch_id") <= batch_id)


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_deleted"))
