"""Set operations on keys: overlaps, reconciliation and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides (must be empty between calibration and holdout)."""
    return a.select(key).intersect(b.select(key))


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``MISSING`` and ``UNEXPECTED`` keys with multiplicities, in one shuffle."""
    e = expected.select(key, F.lit(1).alias("d"))
    f = found.select(key, F.lit(-1).alias("d"))
    d = e.unionByName(f).groupBy(key).agg(F.sum("d").alias("d")).where("d <> 0")
    return d.select(key, F.when(F.col("d") > 0, "MISSING").otherwise("UNEXPECTED").alias("side"), F.abs("d").alias("n"))


def union_keys(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
