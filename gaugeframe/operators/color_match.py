"""Observed against expected colours: assignment, extras, families and distinct colours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.color import delta_e_packed, packed
from gaugeframe.functions.numbers import rint_round
from gaugeframe.operators.assignment import cheapest

NEAR_DUPLICATE_MAX = 2.0


def nearest_named(df: DataFrame, hex_col: str, palette: dict[str, str]) -> DataFrame:
    """``nearest_name, nearest_hex, delta_e``: the palette colour at the least distance, ties to the earlier one.

    Row-local: one distance a palette colour, then the least of them. A colour that cannot be read has none.
    """
    names = list(palette)
    near = df.withColumns({f"__d{i}": delta_e_packed(packed(F.col(hex_col)), packed(F.lit(palette[n]))) for i, n in enumerate(names)})
    best = F.least(*[F.when(F.col(f"__d{i}").isNotNull(), F.struct(F.col(f"__d{i}").alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(palette[n]).alias("hex"))) for i, n in enumerate(names)])
    found = {"nearest_name": F.col("__b.name"), "nearest_hex": F.col("__b.hex"), "delta_e": rint_round(F.col("__b.d"))}
    return near.withColumn("__b", best).withColumns(found).drop("__b", *[f"__d{i}" for i in range(len(names))])


def distinct_colors(bars: DataFrame, key: str, hex_col: str, palette: dict[str, str]) -> DataFrame:
    """Bars of one colour in one image with the nearest palette colour, ranked by covered pixels.

    ``bars`` have ``pixels``, ``support_exact`` and ``support_near``. Distances are taken after grouping, once
    for each distinct colour of an image.
    """
    g = bars.groupBy(key, hex_col).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.sum("pixels").alias("pixel_sum"),
        *[rint_round(f(f"support_{s}")).alias(f"support_{s}_{n}") for s in ("exact", "near") for f, n in ((F.avg, "mean"), (F.min, "min"))],
    )
    # the window sees distinct colours only, at most 2^24 per image
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("pixel_sum").desc(), hex_col))
    return nearest_named(g.withColumn("color_rank", rank.cast("bigint")), hex_col, palette)


def hex_delta(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """CIEDE2000 of two hex columns, row-local; NULL where a colour is missing."""
    return df.withColumn(out, delta_e_packed(packed(F.col(first)), packed(F.col(second))))


def costs(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Distance of every observed colour to the expected ones of its profile, with their number.

    The expected table is a handful of rows, which the optimizer sees and broadcasts by itself.
    """
    sized = expected.withColumn("n_expected", F.count(F.lit(1)).over(Window.partitionBy("profile")))
    return hex_delta(observed.join(sized, "profile"), "observed_hex", "expected_hex", "cost")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _matching(expected: pa.Array, observed: pa.Array, cost: pa.Array) -> pa.Array:
    """Places of the chosen candidates of every image, solved for a whole batch of images at once."""
    counts = pc.fill_null(pc.list_value_length(expected), 0).to_numpy(zero_copy_only=False)
    image, begins = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (expected, observed, cost)]
    at = np.flatnonzero(cheapest(image, *flat))
    ends = np.concatenate([[0], np.bincount(image[at], minlength=len(counts)).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array((at - begins[image[at]]).astype(np.int32)))


def assign(cost: DataFrame, key: str) -> DataFrame:
    """Cheapest one-to-one assignment of observed to expected colours per image.

    Returns key and ``chosen``: one struct per matched expected colour, with the observed colour and
    the distance.  For n expected colours an optimal assignment never needs more than the n nearest
    observed colours of each: any other choice can be swapped for a free one of them at no higher cost.
    So only those survive (a ranked top-n, cut before the shuffle), and an image brings at most n * n
    candidates together, however many colours were observed; n is the size of a profile's palette.
    """
    # a filter on the distance below the window would measure every distance twice
    w = Window.partitionBy(key, "expected_index").orderBy(F.col("cost").asc_nulls_last(), "observed_index")
    top = cost.withColumn("__r", F.row_number().over(w)).where("__r <= n_expected and cost is not null")
    pick = F.struct(F.col("expected_index").cast("bigint").alias("expected_index"), "cost", F.col("observed_index").cast("bigint").alias("observed_index"), "observed_hex", "expected_hex")
    g = top.groupBy(key).agg(F.array_sort(F.collect_list(pick)).alias("candidates"))
    field = lambda n: F.transform("candidates", lambda c: c[n])
    found = _matching(field("expected_index"), field("observed_index"), field("cost"))
    return g.withColumn("found", found).select(key, F.transform("found", lambda i: F.get("candidates", i)).alias("chosen"))


def color_pairs(observed: DataFrame, expected: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """``MATCHED``, ``EXTRA`` and ``MISSING`` rows of every image.

    ``observed``: key, profile, observed_index, observed_hex; ``expected``: profile,
    expected_index, expected_hex (a fixed palette); ``images``: key, profile.
    The decision of an image (one struct per matched colour) is joined on the image key alone, so a hot image
    is an ordinary skewed join that the optimizer splits.  Every row carries the decision in
    ``chosen``.
    """
    chosen = assign(costs(observed, expected, key), key)
    own = F.get(F.filter("chosen", lambda c: c["observed_index"] == F.col("observed_index")), F.lit(0))
    seen = observed.join(chosen, key, "left").withColumn("m", own)
    found = seen.select(
        key, F.when(F.col("m").isNull(), "EXTRA").otherwise("MATCHED").alias("pair_status"), "observed_index", "observed_hex",
        F.col("m.expected_index").alias("expected_index"), F.col("m.expected_hex").alias("expected_hex"), F.col("m.cost").alias("delta_e"), "chosen",
    )
    wanted = images.join(expected, "profile").join(chosen, key, "left")
    met = F.coalesce(F.exists("chosen", lambda c: c["expected_index"] == F.col("expected_index")), F.lit(False))
    missing = wanted.where(~met).select(key, F.lit("MISSING").alias("pair_status"), "expected_index", "expected_hex", "chosen")
    return found.unionByName(missing, allowMissingColumns=True)


def classify_extras(pairs: DataFrame, key: str, threshold: float = NEAR_DUPLICATE_MAX) -> DataFrame:
    """Nearest matched observed colour of every extra one, out of all matched ones of its image."""
    extras = pairs.where("pair_status = 'EXTRA'").select(key, "observed_index", "observed_hex", F.explode_outer("chosen").alias("m"))
    near = hex_delta(extras.withColumn("__h", F.col("m.observed_hex")), "observed_hex", "__h", "__d")
    base = F.when(F.col("__d").isNotNull(), F.struct(F.col("__d").alias("d"), F.col("m.observed_index").alias("i"), F.col("__h").alias("h")))
    e = near.groupBy(key, "observed_index", "observed_hex").agg(F.min(base).alias("b"))
    return e.select(
        key, "observed_index", "observed_hex",
        F.coalesce("b.h", F.lit("")).alias("nearest_hex"),
        F.col("b.d").alias("delta_e"),
        F.when(F.col("b.d") <= threshold, "NEAR_DUPLICATE").otherwise("SEMANTIC_EXTRA_CANDIDATE").alias("extra_class"),
    )


def image_rollup(pairs: DataFrame, key: str) -> DataFrame:
    """Counts, count status, colour lists and distances of the matched colours of every image."""
    from gaugeframe.functions.numbers import count_where, percentile
    from gaugeframe.functions.status import count_status

    kind, d = F.col("pair_status"), F.col("delta_e")

    def hexes(cond, order: str, value: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(order, value)))), lambda s: s[value]), "|")

    g = pairs.groupBy(key).agg(
        count_where(F.col("expected_index").isNotNull()).alias("n_expected"),
        count_where(F.col("observed_hex").isNotNull()).alias("n_observed"),
        count_where(kind == "MATCHED").alias("n_matched"),
        count_where(kind == "EXTRA").alias("n_extra"),
        count_where(kind == "MISSING").alias("n_missing"),
        rint_round(F.avg(d)).alias("dmean"),
        rint_round(percentile(d, 0.5)).alias("dmedian"),
        rint_round(F.max(d)).alias("dmax"),
        hexes(kind == "MATCHED", "expected_index", "observed_hex").alias("matched_hex"),
        hexes(F.col("expected_hex").isNotNull(), "expected_index", "expected_hex").alias("expected_hex"),
        hexes(F.col("observed_hex").isNotNull(), "observed_index", "observed_hex").alias("observed_hex"),
    )
    return g.withColumns({
        "count_status": count_status(F.col("n_observed"), F.col("n_extra"), F.col("n_missing")),
        "count_error_abs": F.abs(F.col("n_observed") - F.col("n_expected")),
    })


#: columns of an extraction that the report hands on as they are
EXTRACTED = ["canvas_width", "canvas_height", "extraction_status", "extraction_support_mean", "extraction_support_min", "n_marks_detected", "n_initial_candidates",
             "n_solid_families", "n_variable_families", "n_insufficient_families", "legend_suspected_count", "n_overlap_derived_families", "line_derived_hex"]


def image_report(pairs: DataFrame, extraction: DataFrame, points: DataFrame, key: str, palette: dict[str, str]) -> DataFrame:
    """The colour row of every extracted image: its extraction, its pairs and its scattered points.

    ``extraction``: key and ``EXTRACTED``, one row an image; absent family, legend and overlap counts are 0.
    ``points``: key and ``delta_e``, the distance of a point to its expected colour, NULL where there is none.
    ``expected_colors`` names the expected colours by ``palette``. All three inputs meet on the image key.
    """
    from gaugeframe.functions.numbers import flag, percentile

    zero = ["n_solid_families", "n_variable_families", "n_insufficient_families", "legend_suspected_count", "n_overlap_derived_families"]
    base = extraction.select(key, *[F.coalesce(c, F.lit(0)).alias(c) if c in zero else c for c in EXTRACTED])
    base = base.withColumns({
        "line_derived_hex": F.coalesce("line_derived_hex", F.lit("")),
        "internal_variation": flag(F.col("n_variable_families") > 0),
        **{c: rint_round(F.col(c)) for c in ("extraction_support_mean", "extraction_support_min")},
    })
    d = F.col("delta_e")
    scatter = points.groupBy(key).agg(
        *[rint_round(e).alias(f"point_{n}") for n, e in (("mean", F.avg(d)), ("median", percentile(d, 0.5)), ("p90", percentile(d, 0.9)), ("max", F.max(d)))]
    )
    names = F.create_map(*[F.lit(x) for n, h in palette.items() for x in (h, n)])
    named = F.array_join(F.transform(F.split("expected_hex", r"\|"), lambda h: F.coalesce(names[h], h)), "|")
    rolled = image_rollup(pairs, key).withColumn("expected_colors", named)
    return base.join(rolled, key, "left").join(scatter, key, "left")
