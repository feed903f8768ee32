"""Colour results per image, unit and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import count_where, flag, iqr, percentile, rint_round
from gaugeframe.functions.status import color_labels
from gaugeframe.operators.quantiles import exact_quantiles

MATCH_THRESHOLD = 2.0


def _positive(c: str) -> Column:
    return flag(F.col(c).try_cast("double") > 0)


def color_flags(images: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Per-image flags, status word and strict match; the match flag stays NULL without a distance."""
    no_mark = F.upper("extraction_status") == "NO_MARK"
    flags = images.withColumns({
        "color_evaluable": flag(~no_mark),
        "color_match": (F.col("dmax") <= threshold).cast("int"),
        "color_deviation": flag(F.col("dmax") > threshold),
        "missing_color": _positive("n_missing"),
        "no_mark": flag(no_mark),
        "semantic_extra": _positive("n_semantic"),
        "near_duplicate": _positive("n_near"),
        "internal_variation": _positive("variation"),
        "overlap_derived": _positive("n_overlap"),
    })
    labels = color_labels(*[F.col(c) for c in ("no_mark", "missing_color", "semantic_extra", "internal_variation", "color_deviation")])
    return flags.withColumn("color_status", labels).withColumn("strict_match", flag(F.col("color_status") == "MATCH"))


def unit_rollup(flags: DataFrame, key: str) -> DataFrame:
    """Distances, rates and the ``status:count`` distribution of every unit.

    One shuffle per grain: status counts are pre-aggregated, then folded into one row per unit, so
    a unit holding a large share of the rows only sends one row per status and map task.
    """
    rates = ["strict_match", "color_deviation", "missing_color", "semantic_extra", "near_duplicate", "no_mark", "internal_variation", "overlap_derived"]
    stats = flags.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("color_evaluable").alias("n_evaluable"),
        rint_round(F.avg("dmax")).alias("dmax_mean"),
        rint_round(percentile(F.col("dmax"), 0.5)).alias("dmax_median"),
        rint_round(iqr(F.col("dmax"))).alias("dmax_iqr"),
        rint_round(F.max("dmax")).alias("dmax_max"),
        *[rint_round(F.avg(r)).alias(f"p_{r}") for r in rates],
        F.sum("n_near").alias("near_duplicate_total"),
        F.sum("n_semantic").alias("semantic_extra_total"),
        F.coalesce(F.sum(F.col("n_missing").try_cast("double")), F.lit(0.0)).cast("bigint").alias("missing_total"),
    )
    words = (
        flags.groupBy(key, "color_status")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "color_status", "n"))), "|").alias("status_distribution"))
    )
    return stats.join(words, key)


def raw_unit_rollup(images: DataFrame, key: str, expected_repeats: int) -> DataFrame:
    """Colour measures of a unit over its repeats, before any threshold.

    ``images``: dmax, dmean (NULL where no colour is matched), n_expected, n_observed, n_matched, n_extra,
    n_missing, extraction_status, internal_variation, n_overlap_derived, support, point_max and point_p90.
    Rates are over all images of a unit, distances over those that have one.
    """
    d = {c: F.col(c) for c in ("dmax", "dmean")}
    n = F.count(F.lit(1))

    def rate(cond: Column) -> Column:
        return rint_round(F.avg(flag(cond)))

    return images.groupBy(key).agg(
        n.alias("n_repeats_found"),
        F.lit(expected_repeats).cast("bigint").alias("expected_repeats"),
        (n == expected_repeats).cast("int").alias("repeats_complete"),
        F.count("dmax").alias("n_color_evaluable"),
        rint_round(F.avg(F.col("n_matched") / F.col("n_expected"))).alias("completeness"),
        *[rint_round(f(c)).alias(f"{x}_{m}") for x, c in d.items() for m, f in (("mean", F.avg), ("median", lambda c: percentile(c, 0.5)), ("iqr", iqr))],
        rint_round(F.max("dmax")).alias("dmax_max"),
        rate(F.col("n_extra") > 0).alias("p_extra"),
        rate(F.col("n_missing") > 0).alias("p_missing"),
        rate((F.col("n_observed") > 0) & (F.col("n_extra") == 0) & (F.col("n_missing") == 0)).alias("p_exact_count"),
        rate(F.col("n_matched") == F.col("n_expected")).alias("p_complete"),
        rate(F.upper("extraction_status") == "NO_MARK").alias("p_no_mark"),
        rate(F.col("internal_variation") == 1).alias("p_internal_variation"),
        rate(F.col("n_overlap_derived") > 0).alias("p_line_overlap_derived"),
        *[rint_round(F.avg(f"n_{c}")).alias(f"{c}_colors_mean") for c in ("observed", "extra", "missing")],
        rint_round(F.avg("support")).alias("support_mean"),
        rint_round(F.min("support")).alias("support_min"),
        rint_round(F.avg("point_max")).alias("point_max_mean"),
        rint_round(F.avg("point_p90")).alias("point_p90_mean"),
    )


def profile_rollup(flags: DataFrame, key: str = "profile") -> DataFrame:
    """Both denominators (all images and evaluable ones) per profile; the median is selected from ranged counts."""
    ev = F.col("color_evaluable") == 1
    dist = F.when(ev, F.col("dmax"))
    stats = flags.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_images"),
        count_where(ev).alias("n_evaluable"),
        F.sum("strict_match").alias("n_strict_match"),
        rint_round(F.avg("strict_match")).alias("p_strict_match_all"),
        rint_round(F.avg(F.when(ev, F.col("strict_match")))).alias("p_strict_match_evaluable"),
        *[F.sum(c).alias(f"n_{c}") for c in ("color_deviation", "missing_color", "semantic_extra", "near_duplicate", "no_mark", "internal_variation", "overlap_derived")],
        rint_round(F.avg(dist)).alias("dmax_mean_evaluable"),
        rint_round(F.max(dist)).alias("dmax_max_evaluable"),
    )
    middle = exact_quantiles(flags, [key], {"_q": (dist, [0.5])}).select(F.col(key).alias("_key"), rint_round(F.col("_q")[0]).alias("dmax_median_evaluable"))
    return stats.join(middle, stats[key].eqNullSafe(middle["_key"]), "left").drop("_key")


def extra_summary(extras: DataFrame, key: str = "filename") -> DataFrame:
    """Per image: how many extras are near duplicates or real candidates, with their colours."""
    near, real = F.col("extra_class") == "NEAR_DUPLICATE", F.col("extra_class") == "SEMANTIC_EXTRA_CANDIDATE"

    def hexes(cond: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("observed_index", "observed_hex")))), lambda s: s["observed_hex"]), "|")

    return extras.groupBy(key).agg(
        count_where(near).alias("n_near_duplicate"),
        count_where(real).alias("n_extra_semantic_candidate"),
        hexes(near).alias("near_duplicate_hex"),
        hexes(real).alias("semantic_extra_hex"),
        F.min(F.when(real, F.col("support"))).alias("semantic_extra_support_min"),
    )
