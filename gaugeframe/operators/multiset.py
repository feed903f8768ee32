"""Multiset comparison of expected and observed values as weighted counts.

Both sides are unioned and counted per (key, value) in one shuffle with map-side combine, so no
side is joined or exploded and a key with very many rows only ships its distinct values. ``diff`` gives the
differing values as rows; the text columns of ``compare`` bring those of a key together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(expected: DataFrame, observed: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``keys, value, n_expected, n_observed``; NULL values count like any other value.

    ``weight`` names a column of ``observed`` that says how often a row was read.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    e = expected.select(*keys, value, one.alias("e"), zero.alias("o"))
    o = observed.select(*keys, value, zero.alias("e"), (F.col(weight).cast("bigint") if weight else one).alias("o"))
    return e.unionByName(o).groupBy(*keys, value).agg(F.sum("e").alias("n_expected"), F.sum("o").alias("n_observed"))


def diff(counts: DataFrame) -> DataFrame:
    """Long form: one row per value that is short or in excess."""
    d = counts.withColumn("delta", F.col("n_observed") - F.col("n_expected")).where("delta <> 0")
    return d.withColumns({"side": F.when(F.col("delta") < 0, "MISSING").otherwise("EXTRA"), "n": F.abs("delta")}).drop("delta")


def detailed_status(n_missing, n_extra):
    return (
        F.when((n_missing == 0) & (n_extra == 0), "NORMALIZED_EQUIVALENT")
        .when(n_extra == 0, "NONCONFORMING_MISSING")
        .when(n_missing == 0, "NONCONFORMING_EXTRA")
        .otherwise("NONCONFORMING_VALUE")
    )


def compare(counts: DataFrame, keys: list[str], value: str, text=None, items: bool = True) -> DataFrame:
    """One row per key: counts, statuses and (optionally) the missing and extra items as text.

    ``text`` renders a value; items are sorted by value and repeated by multiplicity.
    """
    shown = (text or (lambda c: c.cast("string")))(F.col(value))
    short = F.greatest(F.col("n_expected") - F.col("n_observed"), F.lit(0))
    over = F.greatest(F.col("n_observed") - F.col("n_expected"), F.lit(0))

    def listing(n):
        pick = F.when(n > 0, F.struct(F.col(value).alias("v"), F.array_repeat(shown, n.cast("int")).alias("t")))
        return F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(pick)), lambda s: s["t"])), " | ")

    aggs = [
        F.sum("n_expected").alias("n_expected"),
        F.sum("n_observed").alias("n_observed"),
        F.sum(short).alias("n_missing"),
        F.sum(over).alias("n_extra"),
    ]
    if items:
        aggs += [listing(short).alias("missing_items"), listing(over).alias("extra_items")]
    out = counts.groupBy(*keys).agg(*aggs)
    detail = detailed_status(F.col("n_missing"), F.col("n_extra"))
    return out.withColumn("detailed", detail).withColumn(
        "collapsed", F.when(F.col("detailed") == "NORMALIZED_EQUIVALENT", "CONFORMING").otherwise("NONCONFORMING")
    )
