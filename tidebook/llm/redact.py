"""Cut spans out of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def redact(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans (structs with start and end, by start) replaced by ``mark``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
