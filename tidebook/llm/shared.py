"""Staging of intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.sources.staging import release, shared_dir, staged, unstage

__all__ = ["release", "shared_dir", "staged", "table", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
