"""Percentiles of a column: a bounded sketch, or exact ones whose state doesn't grow in one task.

Exact percentiles count equal values first.  A value's rank is the count of the buckets below its own (whole numbers of
``width``) plus a running count inside its bucket, so the windows run over single buckets and over the table of buckets, and
no aggregation holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_percentiles(rows: DataFrame, value: Column, percentiles: dict[str, float], *by: str, width: float = 1.0) -> DataFrame:
    """The columns ``by``, then each named percentile, linear between the neighbouring values; nulls don't count, and a group
    of nulls alone has no row."""
    counts = rows.select(*by, value.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_bucket", F.floor(F.col("_v") / width))
    buckets = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    order = Window.partitionBy(*by).orderBy("_bucket")
    buckets = buckets.withColumns({"_below": F.sum("_size").over(order) - F.col("_size"), "_all": F.sum("_size").over(Window.partitionBy(*by))})
    last = lambda q: q * (F.col("_all") - 1)
    # only buckets with a wanted rank go on
    wanted = F.lit(False)
    for q in percentiles.values():
        for rank in (F.floor(last(q)), F.ceil(last(q))):
            wanted = wanted | ((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_size")))
    near = counts.join(buckets.where(wanted), [*by, "_bucket"])
    upto = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = near.withColumn("_upto", F.col("_below") + upto)
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_v")))
    found = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), *[x for k, q in percentiles.items() for x in (at(F.floor(last(q))).alias(f"_low_{k}"), at(F.ceil(last(q))).alias(f"_high_{k}"))])
    between = lambda k, q: F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (last(q) - F.floor(last(q)))
    return found.select(*by, *[between(k, q).alias(k) for k, q in percentiles.items()])


def percentiles(rows: DataFrame, value: Column, wanted: dict[str, float], *by: str, exact: bool = False, width: float = 1.0) -> DataFrame:
    """The columns ``by`` and each named percentile; without ``exact`` from a sketch of bounded size."""
    if exact:
        return exact_percentiles(rows, value, wanted, *by, width=width)
    return rows.groupBy(*by).agg(*[F.percentile_approx(value.cast("double"), q, ACCURACY).alias(k) for k, q in wanted.items()])
