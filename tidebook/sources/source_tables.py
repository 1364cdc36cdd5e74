"""Source tables of a database, for reconciliation and backfill: read by JDBC where a driver is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_source(spark: SparkSession, url: str, table: str, split: str | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A table of a database; filters and columns that follow are pushed down.  ``split`` names a numeric column by whose range
    the reading is dealt over ``partitions`` connections; without it one connection reads all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split is None:
        return reader.load()
    ends = reader.load().agg(F.min(split).alias("low"), F.max(split).alias("high")).first()  # the database computes them
    if ends.low is None:
        return reader.load()
    bounds = {"partitionColumn": split, "lowerBound": str(ends.low), "upperBound": str(ends.high + 1), "numPartitions": str(partitions)}
    return reader.options(**bounds).load()
