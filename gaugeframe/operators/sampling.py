"""Deterministic audit samples.

Random draws are ranks of ``md5(seed|key)``: the same rows on any cluster, in any partitioning.
A rank kept below a constant is cut inside every map task before the shuffle (window group limit),
so a stratum that holds a third of all rows still sends only a handful of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: str) -> Column:
    """Draw order of a key under a seed; distinct keys never tie in practice, the key breaks ties."""
    return F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys])


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "__rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return out if rank != "__rank" else out.drop(rank)


def best_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key as one aggregate (map-side combine, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order.alias("__o"), F.struct(*rest).alias("r"))).alias("b")).select(*keys, "b.r.*")


def refuse_short(sample: DataFrame, keys: list[str], k: int, strata: DataFrame | None = None) -> DataFrame:
    """The sample, or an error in the same job if a stratum gave fewer than ``k`` rows.

    Counts the drawn rows only, at most ``k`` a stratum. ``strata`` names the strata of a design, so that one
    without any row is refused too.
    """
    said = F.concat(F.lit("short stratum: "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in keys]))
    n = F.count(F.lit(1)).over(Window.partitionBy(*(keys or [F.lit(1)])))
    full = F.when(F.col("__n") >= k, True).otherwise(F.raise_error(F.concat(said, F.lit(" has "), F.col("__n").cast("string"), F.lit(f" of {k}"))).cast("boolean"))
    out = sample.withColumn("__n", n).where(full).drop("__n")
    if strata is not None:
        same = sample.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
        # asked of the joined row: a bare raise_error would be pushed below the join
        met = strata.select(*keys).distinct().join(same.withColumn("__met", F.lit(True)), on, "left")
        never = met.where(F.when(F.col("__met"), False).otherwise(F.raise_error(F.concat(said, F.lit(f" has 0 of {k}"))).cast("boolean"))).select(*keys)
        out = out.unionByName(never, allowMissingColumns=True)
    return out


def stratified(df: DataFrame, keys: list[str], order: list[Column], k: int, strata: DataFrame | None = None) -> DataFrame:
    """Exactly ``k`` rows a stratum; too few are an error."""
    return refuse_short(first_per_group(df, keys, order, k), keys, k, strata)


def unit_sample(units: DataFrame, images: DataFrame, strata: list[str], unit: str, image: str, k: int, seed: int, design: DataFrame | None = None) -> DataFrame:
    """``k`` units per stratum, then one image of each drawn unit; a stratum with fewer units is an error."""
    chosen = stratified(units, strata, [draw(seed, unit)], k, design).select(*strata, unit)
    own = images.select(unit, image).join(chosen, unit)
    return own.groupBy(*strata, unit).agg(F.min_by(image, draw(seed + 1, image)).alias(image))


def whole_units(images: DataFrame, unit: str, repeat: str, first: int, repeats: int) -> DataFrame:
    """Units that own exactly the repeats ``first … first + repeats - 1``, once each."""
    g = images.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(repeat).alias("d"), F.min(repeat).alias("lo"), F.max(repeat).alias("hi")
    )
    return g.where((F.col("n") == repeats) & (F.col("d") == repeats) & (F.col("lo") == first) & (F.col("hi") == first + repeats - 1)).select(unit)


def whole_unit_sample(images: DataFrame, unit: str, repeat: str, first: int, repeats: int, k: int, seed: int) -> DataFrame:
    """``k`` of the units that own all repeats; fewer such units are an error."""
    chosen = whole_units(images, unit, repeat, first, repeats).orderBy(draw(seed, unit)).limit(k)
    none = images.sparkSession.range(1).select(F.lit("units").alias("__design"))
    return refuse_short(chosen.withColumn("__design", F.lit("units")), ["__design"], k, none).drop("__design")


def blind_cases(df: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows per stratum, shuffled together and numbered ``CASE_001`` onwards, wider from 1000; too few are an error.

    The numbering orders the drawn sample only, ``k`` rows per stratum.
    """
    s = stratified(df, [stratum], [draw(seed, key)], k)
    n = F.row_number().over(Window.orderBy(draw(seed + 1, key))).cast("string")
    # lpad alone would cut numbers above 999
    return s.withColumn("case_id", F.concat(F.lit("CASE_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def quota_sample(df: DataFrame, stratum: str, key: str, ok: str, stress: Column, n: int, seed: int) -> DataFrame:
    """Half good, half bad canvases per stratum, topped up at random, plus every stress row."""
    n_ok = n // 2
    keep = F.col("__rank") <= F.when(F.col(ok) == 1, n_ok).otherwise(n - n_ok)
    ranked = first_per_group(df.where(F.col(ok).isin(0, 1)), [stratum, ok], [draw(seed, key)], n, rank="__rank_")
    chosen = ranked.withColumnRenamed("__rank_", "__rank").where(keep).select(stratum, key)
    have = chosen.groupBy(stratum).agg(F.count(F.lit(1)).alias("__have"))
    rest = df.select(stratum, key).join(chosen.select(key), key, "left_anti")
    extra = first_per_group(rest, [stratum], [draw(seed + 1, key)], n, rank="__rank_").join(have, stratum, "left")
    extra = extra.where(F.col("__rank_") <= n - F.coalesce("__have", F.lit(0))).select(stratum, key)
    stressed = df.where(stress).select(stratum, key)
    keys = chosen.unionByName(extra).unionByName(stressed).distinct()
    return df.join(keys.select(key), key, "left_semi").withColumn("is_stress", F.coalesce(stress.cast("int"), F.lit(0)))


def risk_selection(df: DataFrame, stratum: str, key: str, conf: str, spread: str, k_low: int, k_high: int, k_random: int, seed: int) -> DataFrame:
    """Lowest confidence, then highest spread, then random rows; the earlier reason wins."""
    cols = [stratum, key]
    low = first_per_group(df, [stratum], [F.col(conf), F.col(key)], k_low).select(*cols, F.lit("LOW_CONFIDENCE").alias("reason"), F.lit(1).alias("p"))
    high = first_per_group(df.where(F.col(spread).isNotNull()), [stratum], [F.col(spread).desc(), F.col(key)], k_high)
    high = high.select(*cols, F.lit("HIGH_SPREAD").alias("reason"), F.lit(2).alias("p"))
    risky = low.unionByName(high).groupBy(*cols).agg(F.min_by("reason", "p").alias("reason"))
    rest = df.select(*cols).join(risky.select(key), key, "left_anti")
    rand = first_per_group(rest, [stratum], [draw(seed, key)], k_random).select(*cols, F.lit("RANDOM_STRATIFIED").alias("reason"))
    return risky.unionByName(rand)


def first_preferred(df: DataFrame, stratum: str, key: str, preferred: Column, k: int) -> DataFrame:
    """First ``k`` preferred rows by key, or the first ``k`` of any kind where too few are preferred."""
    n = df.groupBy(stratum).agg(F.count(F.when(preferred, 1)).alias("__n"))
    good = first_per_group(df.where(preferred), [stratum], [F.col(key)], k).select(stratum, key)
    any_ = first_per_group(df, [stratum], [F.col(key)], k).select(stratum, key)
    full, short = n.where(F.col("__n") >= k).select(stratum), n.where(F.col("__n") < k).select(stratum)
    return good.join(full, stratum, "left_semi").unionByName(any_.join(short, stratum, "left_semi"))
