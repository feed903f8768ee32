"""Pair statistics of a group without forming its pairs.

Positions are first counted per distinct value (map-side combine), then one ordered pass with
running sums gives every pair total exactly: the sum of all gaps is the sum over sorted values of
``x * (rows before) - (sum before)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import rint_round


def pair_gaps(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Per group: number of pairs, smallest and largest gap and the mean gap over all pairs."""
    w = Window.partitionBy(key).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.groupBy(key, pos).agg(F.count(F.lit(1)).alias("m"))
    d = d.withColumns({
        "n_before": F.coalesce(F.sum("m").over(before), F.lit(0)),
        "s_before": F.coalesce(F.sum(F.col("m") * F.col(pos)).over(before), F.lit(0.0)),
        "gap": F.col(pos) - F.lag(pos).over(w),
    })
    n = F.sum("m")
    return d.groupBy(key).agg(
        (n * (n - 1) / 2).cast("bigint").alias("n_pairs"),
        F.when(F.max("m") > 1, F.lit(0.0)).otherwise(F.min("gap")).alias("min_gap"),
        F.when(n > 1, F.max(pos) - F.min(pos)).alias("max_gap"),
        rint_round(F.try_divide(F.sum(F.col("m") * (F.col(pos) * F.col("n_before") - F.col("s_before"))), n * (n - 1) / 2)).alias("mean_gap"),
    )
