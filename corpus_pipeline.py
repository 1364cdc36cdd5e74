"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Each stage takes what its predecessor kept, as a table read again from Parquet.  The first three drop documents (toxic ones;
all but one of each group of near copies; those that hold a benchmark window), the fourth cuts live-looking secrets out of
the texts, the last packs the tokens.  Decisions are those of single rows, whatever their doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, near_dup, packing, secret_scan, toxicity
from tidebook.llm.redact import redact
from tidebook.llm.shared import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.without_toxic(docs, weights, 0.7)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a row id, ``_row``, that holds in every later read: doc_ids may repeat or be null."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group stays, the first of them where it repeats; a null id comes last.  Groups
    are those of five-word shingles, as this stage has no contract that says otherwise (op3's says four)."""
    rows = numbered(docs)
    found = staged(near_dup.grouped(rows.withColumnRenamed("_row", "row"), size=5, percent=80), "groups")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("row").alias("row"))
    copies = staged(found.join(first, "row", "left_anti").select(F.col("row").alias("_row")), "copies")
    return rows.join(copies, "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"), keep=docs.columns, out="_spans")
    live = F.filter("_spans", lambda s: s["live"])
    cut = F.size(live) > 0
    text = F.when(cut, redact(F.col("text"), live, "[SECRET]")).otherwise(F.col("text"))
    rows = found.withColumn("n_chars", F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text)
    return rows.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", cut_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the packing; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
