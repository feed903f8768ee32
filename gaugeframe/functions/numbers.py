"""Rounding, safe casts and ratios with the null model used throughout (NULL = missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rint_round(c: Column, digits: int = 6) -> Column:
    """Half-even rounding at ``digits`` decimals (``F.round`` is half-up)."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def safe_float(c: Column) -> Column:
    """Text or number to double; unparsable text and NaN become NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def fmt6(c: Column) -> Column:
    return rint_round(safe_float(c), 6)


def ratio(num: Column, den: Column, digits: int | None = 6) -> Column:
    """``num/den`` or NULL when the denominator is zero."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if digits is None else rint_round(q, digits)


def count_where(cond: Column) -> Column:
    """Conditional count that partial-aggregates and never returns NULL."""
    return F.count(F.when(cond, F.lit(1)))


def flag(cond: Column) -> Column:
    """Condition to 0/1 with NULL counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def percentile(c: Column, q: float) -> Column:
    """Linear-interpolated quantile.

    The aggregate keeps value -> count per group, merged map-side, so its state is bounded by the
    number of distinct values (descriptors are quantised), not by the number of rows.
    """
    return F.percentile(c, F.lit(q))


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once: the rounding errors of product and sum are found and added back."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
        return high, x - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    off = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    more = s - p
    return s + ((p - (s - more)) + (c - more) + off)


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array, NULL when it is empty.

    To the last bit what the SQL twins' ``quantile_cont`` gives, for quantiles that are compared before
    they are rounded; ``percentile`` may differ from it in that bit.
    """
    at = (F.size(values) - 1) * F.lit(q)
    low, part = F.get(values, F.floor(at).cast("int")), at - F.floor(at)
    high = F.get(values, F.ceil(at).cast("int"))
    return F.when(part == 0, low).otherwise(fused(low, 1 - part, high * part))


def iqr(c: Column) -> Column:
    return percentile(c, 0.75) - percentile(c, 0.25)


def fixed_rows(spark: SparkSession, name: str, values: list) -> DataFrame:
    """A fixed short list as a one-column table, built in the JVM."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
