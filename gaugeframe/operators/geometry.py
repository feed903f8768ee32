"""Presence and layout decisions from boxes, segments and markers of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import count_where, percentile, rint_round

# --- fixed values -------------------------------------------------------------------------------
BAR_AREA_MIN, BAR_HEIGHT_MIN = 0.0015, 0.055
LINE_SPAN_MIN, LINE_BIN_MIN = 0.24, 0.20
MARKER_DISPERSION_MIN = 0.03
X_PLAUSIBLE, Y_PLAUSIBLE = (0.015, 0.995), (0.015, 0.985)
FRAME_MIN_SIZE = 0.35
# ------------------------------------------------------------------------------------------------


def _cap(c: Column, top: float = 1.0) -> Column:
    return F.least(F.lit(top), c)


def with_absent(found: DataFrame, images: DataFrame | None, key: str, values: dict[str, object]) -> DataFrame:
    """``found`` with a row of ``values`` for every image that has none."""
    if images is None:
        return found
    return images.select(key).distinct().join(found, key, "left").na.fill(values)


def bar_presence(rects: DataFrame, key: str, roi_height: float, roi_area: float, images: DataFrame | None = None) -> DataFrame:
    """``rects``: key, h, area; ``images`` without rectangles are absent with confidence 0."""
    n, area, tall = F.count(F.lit(1)), F.sum("area"), F.max(F.col("h") / roi_height)
    g = rects.groupBy(key).agg(n.alias("n"), area.alias("area"), tall.alias("tall"))
    single = (F.col("n") == 1) & (F.col("area") >= BAR_AREA_MIN * roi_area) & (F.col("tall") >= BAR_HEIGHT_MIN)
    present = (F.col("n") >= 2) | single
    conf = 0.35 + 0.17 * _cap(F.col("n"), 4) + 0.30 * _cap(F.col("area") / (0.020 * roi_area)) + 0.18 * _cap(F.col("tall") / 0.25)
    out = g.select(key, present.cast("int").alias("present"), rint_round(F.when(present, _cap(conf)).otherwise(0.20)).alias("confidence"), F.col("n").alias("n_candidates"), rint_round(F.col("tall")).alias("max_h_frac"))
    return with_absent(out, images, key, {"present": 0, "confidence": 0.0, "n_candidates": 0, "max_h_frac": 0.0})


def line_presence(evidence: DataFrame, span: str, support: str) -> DataFrame:
    s, b = F.col(span), F.col(support)
    present = (s >= LINE_SPAN_MIN) | (b >= LINE_BIN_MIN)
    conf = 0.25 + 0.80 * _cap(s) + 0.55 * _cap(b / 0.50)
    return evidence.withColumns({"present": present.cast("int"), "confidence": rint_round(F.when(present, _cap(conf)).otherwise(0.15))})


def scatter_presence(markers: DataFrame, key: str, width: float, height: float, images: DataFrame | None = None) -> DataFrame:
    """``markers``: key, cx, cy; ``images`` without markers are absent with the least confidence."""
    many = F.count(F.lit(1)) >= 2
    g = markers.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(many, (F.max("cx") - F.min("cx")) / width).otherwise(0.0).alias("xd"),
        F.when(many, (F.max("cy") - F.min("cy")) / height).otherwise(0.0).alias("yd"),
    )
    present = (F.col("n") >= 2) & ((F.col("xd") >= MARKER_DISPERSION_MIN) | (F.col("yd") >= MARKER_DISPERSION_MIN))
    conf = 0.25 + 0.12 * _cap(F.col("n"), 5) + 0.40 * _cap(F.col("xd") + F.col("yd"))
    weak = F.when(F.col("n") == 1, 0.30).otherwise(0.10)
    out = g.select(key, present.cast("int").alias("present"), rint_round(F.when(present, _cap(conf)).otherwise(weak)).alias("confidence"), F.col("n").alias("n_markers"), rint_round(F.col("xd")).alias("x_dispersion"), rint_round(F.col("yd")).alias("y_dispersion"))
    return with_absent(out, images, key, {"present": 0, "confidence": 0.10, "n_markers": 0, "x_dispersion": 0.0, "y_dispersion": 0.0})


def plot_frame(groups: DataFrame, key: str, width: float, height: float, images: DataFrame | None = None) -> DataFrame:
    """Plot edges by consensus of horizontal (``x1, x2`` at ``y``) and vertical groups.

    ``groups``: key, orient (H/V), a, b (extent along its direction) and c (its coordinate).
    Medians need two groups of a direction; otherwise the outermost crossing groups stand in.
    ``images`` without groups are ``INCOMPLETE``.
    """
    x_ok = lambda c: c.between(X_PLAUSIBLE[0] * width, X_PLAUSIBLE[1] * width)
    y_ok = lambda c: c.between(Y_PLAUSIBLE[0] * height, Y_PLAUSIBLE[1] * height)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    is_h, is_v = F.col("orient") == "H", F.col("orient") == "V"
    h, v = is_h & x_ok(a) & x_ok(b) & y_ok(c), is_v & x_ok(c) & y_ok(a) & y_ok(b)

    def med(cond, col):
        return F.rint(percentile(F.when(cond, col), 0.5))

    def sd(cond, col, size):
        return F.stddev_pop(F.when(cond, col)) / size

    g = groups.groupBy(key).agg(
        count_where(h).alias("n_h"), count_where(v).alias("n_v"),
        med(h, a).alias("hl"), med(h, b).alias("hr"), med(v, a).alias("vt"), med(v, b).alias("vb"),
        F.min(F.when(v, c)).alias("vmin"), F.max(F.when(v, c)).alias("vmax"),
        F.min(F.when(h, c)).alias("hmin"), F.max(F.when(h, c)).alias("hmax"),
        sd(h, a, width).alias("s1"), sd(h, b, width).alias("s2"), sd(v, a, height).alias("s3"), sd(v, b, height).alias("s4"),
    )
    two_h, two_v = F.col("n_h") >= 2, F.col("n_v") >= 2

    def edge(first, name, second, other):
        return F.when(first, F.col(name)).when(second, F.col(other).cast("double"))

    g = g.withColumns({
        "left": edge(two_h, "hl", two_v, "vmin"), "right": edge(two_h, "hr", two_v, "vmax"),
        "top": edge(two_v, "vt", two_h, "hmin"), "bottom": edge(two_v, "vb", two_h, "hmax"),
    })
    found = F.col("left").isNotNull() & F.col("top").isNotNull()
    reversed_ = (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))
    small = ((F.col("right") - F.col("left")) / width < FRAME_MIN_SIZE) | ((F.col("bottom") - F.col("top")) / height < FRAME_MIN_SIZE)
    spreads = F.array_compact(F.array("s1", "s2", "s3", "s4"))
    spread = F.when(F.size(spreads) > 0, F.aggregate(spreads, F.lit(0.0), lambda x, y: x + y) / F.size(spreads))
    out = g.select(
        key, "n_h", "n_v", "left", "right", "top", "bottom",
        F.when(~found, "INCOMPLETE").when(reversed_, "INVALID_GEOMETRY").when(small, "LOW_CONFIDENCE").otherwise("OK").alias("status"),
        rint_round(spread).alias("spread_norm"),
        F.coalesce(rint_round(F.greatest(F.lit(0.0), 1.0 - 4.0 * spread)), F.lit(0.0)).alias("confidence"),
    )
    return with_absent(out, images, key, {"n_h": 0, "n_v": 0, "status": "INCOMPLETE", "confidence": 0.0})


def tick_lane(boxes: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Label boxes kept in the lane of their axis, as counts and a status per image.

    ``boxes``: key, axis, x1, y1, x2, y2; ``frames``: key, left, right, top, bottom.  The nearest
    distance is an aggregate joined back, so no image is ordered or held in one window.
    """
    keys = [key, "axis"]
    d = boxes.join(frames, key, "left")
    is_y = F.col("axis") == "Y"
    wide = F.greatest(F.lit(1.0), F.col("right") - F.col("left"))
    tall = F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))
    slack = F.greatest(F.lit(3.0), 0.035 * F.when(is_y, tall).otherwise(wide))
    mid = F.when(is_y, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    lo, hi = F.when(is_y, F.col("top")).otherwise(F.col("left")), F.when(is_y, F.col("bottom")).otherwise(F.col("right"))
    away = F.when(is_y, F.col("left") - F.col("x2")).otherwise(F.col("y1") - F.col("bottom"))
    tol = F.when(is_y, F.greatest(F.lit(8.0), 0.022 * wide)).otherwise(F.greatest(F.lit(8.0), 0.020 * tall))
    known = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull()
    d = d.withColumns({"known": known, "along": known & mid.between(lo - slack, hi + slack), "tol": tol})
    d = d.withColumn("dist", F.when(F.col("along") & (away >= -4), F.abs(away)))
    near = d.groupBy(*keys).agg(F.min("dist").alias("ref"))
    j = d.join(near, keys)
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.min(F.col("known").cast("int")).alias("known"),
        count_where(F.col("along")).alias("n_along"),
        count_where(F.col("dist") <= F.col("ref") + F.col("tol")).alias("n_near"),
        F.min("ref").alias("reference_distance"),
    )
    status = (
        F.when(F.col("known") == 0, "UNAVAILABLE")
        .when(F.col("n_along") == 0, "LONGITUDINAL_EMPTY")
        .when(F.col("reference_distance").isNull(), "LONGITUDINAL_ONLY")
        .when(F.col("n_near") < F.col("n_along"), "FILTERED_2D")
        .when(F.col("n_before") > F.col("n_along"), "LONGITUDINAL_FILTERED")
        .otherwise("UNCHANGED")
    )
    after = F.when(F.col("known") == 0, F.col("n_before")).when(F.col("reference_distance").isNull(), F.col("n_along")).otherwise(F.col("n_near"))
    return g.select(*keys, "n_before", "n_along", after.alias("n_after"), "reference_distance", status.alias("status"))


def small_boxes_dropped(boxes: DataFrame, key: str, size: str, cross: str) -> DataFrame:
    """Boxes that are not tiny against the other boxes of their image (medians joined back)."""
    med = boxes.groupBy(key).agg(percentile(F.when(F.col(size) > 0, F.col(size)), 0.5).alias("__s"), percentile(F.col(cross), 0.5).alias("__c"))
    tiny = (F.col(size) < F.greatest(F.lit(8.0), 0.22 * F.col("__s"))) & (F.col(cross) < 0.70 * F.greatest(F.lit(8.0), F.col("__c")))
    return boxes.join(med, key).where(~tiny & F.col("__s").isNotNull()).drop("__s", "__c")


def axis_label_blocks(blocks: DataFrame, min_gap: float = 1.2, center_tol: float = 0.25) -> DataFrame:
    """Distant text blocks that can be an axis title.

    ``blocks``: axis, cx, cy, w, h, glyph and the frame columns left, right, left_axis, bottom_axis.
    """
    centered = F.abs(F.col("cx") - (F.col("left") + F.col("right")) / 2) / F.greatest(F.lit(1.0), F.col("right") - F.col("left")) <= center_tol
    below = F.col("cy") - F.col("bottom_axis") >= min_gap * F.col("glyph")
    beside = F.col("left_axis") - F.col("cx") >= min_gap * F.col("glyph")
    upright = F.col("h") > 1.8 * F.greatest(F.lit(1.0), F.col("w"))
    return blocks.where(F.when(F.col("axis") == "X", centered & below).otherwise(beside & upright))
