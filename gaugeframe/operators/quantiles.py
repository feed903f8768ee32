"""Exact quantiles of groups of any size, by selecting order statistics from ranged counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.scan import running, spread_join
from gaugeframe.sources.tables import written


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """Per group one array column a name of ``wanted``: the linear-interpolated quantiles of its values.

    ``percentile`` keeps every distinct value of a group in one aggregate, so a hot group is one task. Here
    rows are first counted per (group, value), which spreads over all tasks; the counts are ranged by group
    and value, so that a group is cut over several parts, and summed up from part to part. A value is kept
    if the places it covers hold one of the wanted order statistics: a few rows a group and quantile.

    Nulls are no values; NaN is the largest. A group without any value has no row. Null keys are a group.
    """
    cells = [F.struct(F.lit(i).alias("_m"), c.cast("double").alias("_v")) for i, (c, _) in enumerate(wanted.values())]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_x")).select(*keys, "_x._m", "_x._v").where("_v is not null")
    counts = written(rows.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n")))
    group = F.struct(*keys, "_m").alias("_k")  # fields of structs are equal where both are null
    totals = written(counts.groupBy(group).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_weight")))
    upto = running(counts.withColumn("_upto", F.col("_n")), [*keys, "_m"], ["_v"], sums=["_upto"])
    placed = spread_join(upto.select("*", group), totals, ["_k"], "_weight")

    def covers(place: Column) -> Column:
        return (place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto"))

    marks = [(i, q) for i, (_, qs) in enumerate(wanted.values()) for q in qs]
    at = lambda q: F.lit(q) * (F.col("_total") - 1)
    held = {}
    for j, (i, q) in enumerate(marks):
        mine = F.col("_m") == i
        held[f"_low{j}"] = F.when(mine & covers(F.floor(at(q))), F.col("_v"))
        held[f"_high{j}"] = F.when(mine & covers(F.ceil(at(q))), F.col("_v"))
    few = placed.withColumns(held).where(F.coalesce(*held).isNotNull())
    sizes = [F.max(F.when(F.col("_m") == i, F.col("_total"))).alias(f"_total{i}") for i in range(len(wanted))]
    found = few.groupBy(*keys).agg(*[F.max(c).alias(c) for c in held], *sizes)

    def value(j: int, i: int, q: float) -> Column:
        place, low, high = F.lit(q) * (F.col(f"_total{i}") - 1), F.col(f"_low{j}"), F.col(f"_high{j}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(between)

    out, j = [], 0
    for i, (name, (_, qs)) in enumerate(wanted.items()):
        some = F.array(*[value(j + n, i, q) for n, q in enumerate(qs)])
        out.append(F.when(F.col(f"_total{i}").isNotNull(), some).alias(name))
        j += len(qs)
    return found.select(*keys, *out)
