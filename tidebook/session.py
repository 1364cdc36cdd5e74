"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidebook", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as two underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
