"""Intermediate tables in the folder that driver and executors share, so that lineage ends there and lost executors cost nothing.

A session's tables lie under one folder.  Those that are read no more go at once (``unstage``), the others when the Python
process ends or ``release`` is called: until then the DataFrames that a query returned may still read them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where it is unset, a single machine gets a temporary one; a cluster has
    to name it, as executors elsewhere would not see a folder of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of the application's own tables; it goes when the process ends."""
    folder = f"{shared_dir(spark)}/tidebook-{spark.sparkContext.applicationId}"
    _FOLDERS.add(folder)
    return folder


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def short_shuffles(spark: SparkSession):
    """Queries that run in here delete their shuffle files when they end; else these lie until the driver happens to collect its
    garbage.  It holds for DataFrames that are made in here and written or collected in here."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None or context is None or context._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``staged`` returned, if it is one; nothing may read it any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(path)


@atexit.register
def release() -> None:
    """Delete all tables that this process staged."""
    for folder in list(_FOLDERS):
        try:
            _delete(folder)
        except Exception:  # noqa: BLE001 - the session or the folder may be gone
            pass
        _FOLDERS.discard(folder)
