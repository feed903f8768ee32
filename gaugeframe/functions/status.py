"""Row rules: raw descriptor values to status words.  NULL means the input is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions.text import falsey, literal_map, truthy

C, NC, U = "CONFORMING", "NONCONFORMING", "UNEVALUABLE"
U_SPEC, PENDING = "UNEVALUABLE_SPEC_CONFLICT", "PENDING_FINAL_ADJUDICATION"

# --- fixed values -------------------------------------------------------------------------------
IMAGE_NAME = r"(?i)^(BI|BC|LI|LC|SI|SC)_(\d{3})_R(\d{2})\.(png|jpg|jpeg)$"
PROFILES = ["BI", "BC", "LI", "LC", "SI", "SC"]
EXPECTED_CLASS = {"BI": "BAR", "BC": "BAR", "LI": "LINE", "LC": "LINE", "SI": "SCATTER", "SC": "SCATTER"}
SPEC_CONFLICT_UNITS = ["SC_024", "SC_037"]
FOUR_CLASSES = ["BAR", "LINE", "SCATTER", "OTHER"]
BAR_MIN_HEIGHT, LINE_MIN_SUPPORT, MARKERS_MIN, DISPERSION_MIN = 0.10, 0.50, 2, 0.03
LAYER_NEAR_MAX, LAYER_MIN_GROUPS, LAYER_MIN_SPAN = 0.45, 2, 0.12
CONGESTED_MIN_BINS, CONGESTED_MIN_EXTENT, CONGESTED_MIN_RATIO = 8, 0.28, 0.16
TARGET_FRAME = {"left": 0.08, "right": 0.95, "top": 0.88, "bottom": 0.15}
CANVAS = (1200, 800)
VALUE_BANDS = [(500_000, "AZUL"), (300_000_000, "VERDE"), (600_000_000, "ROXO")]
VALUE_BAND_TOP = "VERMELHO"
ORIENTATION_MARGIN = 0.08
RIDGE_SUPPORT_MIN, RIDGE_RUN_MIN = 0.32, 0.28
# ------------------------------------------------------------------------------------------------


def _up(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def parse_image_name(name: Column) -> dict[str, Column]:
    """Columns of an image file name; a bad name gives NULLs and ``name_valid = 0``."""
    ok = name.rlike(IMAGE_NAME)
    profile = F.when(ok, F.upper(F.regexp_extract(name, IMAGE_NAME, 1)))
    unit = F.when(ok, F.regexp_extract(name, IMAGE_NAME, 2))
    rep = F.when(ok, F.regexp_extract(name, IMAGE_NAME, 3))
    return {
        "profile": profile,
        "technique": F.substring(profile, 1, 1),
        "task": F.substring(profile, 2, 1),
        "unit_number": unit.cast("int"),
        "repeat": rep.cast("int"),
        "unit_id": F.concat(profile, F.lit("_"), unit),
        "image_id": F.concat(profile, F.lit("_"), unit, F.lit("_R"), rep),
        "name_valid": F.coalesce(ok, F.lit(False)).cast("int"),
    }


def mark_status(raw: Column, present: Column, absent: Column) -> Column:
    up = _up(raw)
    return (
        F.when(up.contains("ABSENT") | truthy(absent), NC)
        .when(up.contains("PRESENT") | truthy(present), C)
        .otherwise(U)
    )


def axis_status(raw: Column, x_eval: Column, y_eval: Column, x_present: Column, y_present: Column) -> Column:
    up = _up(raw)
    return (
        F.when(up == "BOTH_PRESENT", C)
        .when(up.isin(U, "NOT_EVALUABLE"), U)
        .when(truthy(x_eval) & truthy(y_eval), F.when(truthy(x_present) & truthy(y_present), C).otherwise(NC))
        .when(up != "", NC)
        .otherwise(U)
    )


def color_dimension_status(raw: Column, evaluable: Column, no_mark: Column, strict: Column) -> Column:
    return (
        F.when(truthy(no_mark) | ~truthy(evaluable), U)
        .when(truthy(strict) | (_up(raw) == "MATCH"), C)
        .otherwise(NC)
    )


def manual_presence(x: Column, y: Column, text: Column) -> Column:
    """Status decided by a human review, NULL when the review decides nothing."""
    decided_x, decided_y = truthy(x) | falsey(x), truthy(y) | falsey(y)
    up = _up(text)
    return (
        F.when(truthy(x) & truthy(y), C)
        .when(decided_x & decided_y, NC)
        .when(up.isin("BOTH_PRESENT", C, "OK", "PRESENT"), C)
        .when(up.isin("X_ONLY", "Y_ONLY", "NONE", "ABSENT", NC), NC)
        .when(up.isin(U, "NOT_EVALUABLE"), U)
    )


def presence_decision(needs_review: Column, both_auto: Column, manual: Column) -> Column:
    """``STRUCT<status,source>``; an unreviewed exception stays pending."""
    use_manual = (truthy(needs_review) | ~truthy(both_auto)) & manual.isNotNull()
    status = (
        F.when(use_manual, manual).when(truthy(needs_review), PENDING).when(truthy(both_auto), C).otherwise(PENDING)
    )
    source = (
        F.when(use_manual, "MANUAL_REVIEW")
        .when(truthy(needs_review), "REVIEW_REQUIRED")
        .when(truthy(both_auto), "AUTO_FROZEN")
        .otherwise("AUTO_EXCEPTION")
    )
    return F.struct(status.alias("status"), source.alias("source"))


def pair_presence(x_eval: Column, y_eval: Column, x: Column, y: Column) -> Column:
    """Joint X/Y presence word; needs both axes evaluable."""
    has_x, has_y = F.coalesce(x, F.lit(0)) == 1, F.coalesce(y, F.lit(0)) == 1
    both = (F.coalesce(x_eval, F.lit(0)) == 1) & (F.coalesce(y_eval, F.lit(0)) == 1)
    return (
        F.when(~both, U)
        .when(has_x & has_y, "BOTH_PRESENT")
        .when(has_x, "X_ONLY")
        .when(has_y, "Y_ONLY")
        .otherwise("NONE")
    )


def evidence_map(c: Column) -> Column:
    """``"K=v;K2=v2"`` to ``MAP<STRING,DOUBLE>``; broken parts are skipped and the last repeat wins."""
    parts = F.filter(F.reverse(F.split(c, ";")), lambda p: p.contains("="))
    entries = F.filter(
        F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").try_cast("double").alias("v"))),
        lambda e: e["v"].isNotNull(),
    )
    # newest first: an entry is kept when no earlier one has its key
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,double>"),
        lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))),
    )


def evidence_value(c: Column, key: str) -> Column:
    """Last well-formed value of one key, zero when there is none."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"(?:^|;){key}=([^;]*)"), F.lit(1)), lambda v: v.try_cast("double"))
    good = F.array_compact(found)
    return F.coalesce(F.get(good, F.size(good) - 1), F.lit(0.0))


def exclusive_class(height: Column, support: Column, markers: Column, xdisp: Column, ydisp: Column) -> Column:
    """First matching class rule as ``STRUCT<observed,reason>``; never looks at the expected class."""
    bar, line = height >= BAR_MIN_HEIGHT, support >= LINE_MIN_SUPPORT
    dots = (F.floor(markers) >= MARKERS_MIN) & ((xdisp >= DISPERSION_MIN) | (ydisp >= DISPERSION_MIN))
    return F.struct(
        F.when(bar, "BAR").when(line, "LINE").when(dots, "SCATTER").otherwise("OTHER").alias("observed"),
        F.when(bar, "BAR_MAX_H_FRAC>=0.10")
        .when(line, "LINE_XBIN_SUPPORT>=0.50")
        .when(dots, "SCATTER_MARKERS_AND_DISPERSION")
        .otherwise("NO_EXCLUSIVE_RULE")
        .alias("reason"),
    )


def alternate_class(expected: Column, height: Column, support: Column, markers: Column, xdisp: Column, ydisp: Column) -> Column:
    hits = F.array_compact(
        F.array(
            F.when((expected != "B") & (height >= BAR_MIN_HEIGHT), F.lit("BAR")),
            F.when((expected != "L") & (support >= LINE_MIN_SUPPORT), F.lit("LINE")),
            F.when(
                (expected != "S") & (F.floor(markers) >= MARKERS_MIN) & (xdisp >= DISPERSION_MIN) & (ydisp >= DISPERSION_MIN),
                F.lit("SCATTER"),
            ),
        )
    )
    return (
        F.when(F.size(hits) == 0, "OTHER_OR_EMPTY")
        .when(F.size(hits) == 1, F.get(hits, F.lit(0)))
        .otherwise(F.concat(F.lit("MIXED_CANDIDATE:"), F.array_join(hits, "+")))
    )


def signature(bar: Column, line: Column, scatter: Column) -> Column:
    parts = F.array_compact(
        F.array(*[F.when(c == 1, F.lit(n)) for c, n in ((bar, "BAR"), (line, "LINE"), (scatter, "SCATTER"))])
    )
    return (
        F.when(F.size(parts) == 0, "NONE_OR_OTHER")
        .when(F.size(parts) == 1, F.concat(F.get(parts, F.lit(0)), F.lit("_ONLY")))
        .otherwise(F.array_join(parts, "_"))
    )


def four_class(manual: Column) -> Column:
    up = _up(manual)
    return F.when(up.isin(FOUR_CLASSES), up).when(up == "EMPTY_NO_DATA", "OTHER").otherwise(U)


def validation_match(manual4: Column, auto: Column) -> Column:
    return F.when(manual4 == U, U).when(_up(auto) == manual4, "MATCH").otherwise("MISMATCH")


def expected_class(profile: Column) -> Column:
    return F.element_at(literal_map(EXPECTED_CLASS), profile)


def layer_presence(seg: Column, groups: Column, span: Column, bins: Column, extent: Column, share: Column, near: Column) -> Column:
    """``STRUCT<present,evidence>`` from the three kinds of layer evidence."""
    usable = near.isNotNull() & ~F.isnan(near) & (near <= LAYER_NEAR_MAX)
    discrete = usable & (groups >= LAYER_MIN_GROUPS) & (span >= LAYER_MIN_SPAN)
    congested = usable & (bins >= CONGESTED_MIN_BINS) & (extent >= CONGESTED_MIN_EXTENT) & (share >= CONGESTED_MIN_RATIO)
    words = F.array_compact(
        F.array(
            F.when(seg == 1, F.lit("SEG")), F.when(discrete, F.lit("DISCRETE")), F.when(congested, F.lit("CONGESTED"))
        )
    )
    return F.struct(
        (usable & (F.size(words) > 0)).cast("int").alias("present"),
        F.when(F.size(words) == 0, "NONE").otherwise(F.array_join(words, "+")).alias("evidence"),
    )


def extraction_support(
    kind: Column, mode: Column, share: Column, has_text: Column, band_usable: Column, band_found: Column,
    monotone: Column, scale: Column, selection: Column,
) -> Column:
    some = has_text | band_usable
    weaker = F.when(some, "PARTIAL_CANDIDATE").otherwise("FAIL_CANDIDATE")
    strong_time = (share >= 0.75) & F.coalesce(monotone == 1, F.lit(True))
    strong_num = (share >= 0.75) & (scale != "AMBIGUOUS") & selection.isin("COHERENT_DIRECT", "SELECTED_BY_COHERENCE")
    return (
        F.when(mode == "FAILED", "FAIL_CANDIDATE")
        .when(kind == "categorical", F.when(has_text & band_usable & band_found, "MULTI_EVIDENCE").otherwise("SINGLE_EVIDENCE"))
        .when(kind == "temporal", F.when(strong_time, "STRONG_CANDIDATE").otherwise(weaker))
        .otherwise(F.when(strong_num, "STRONG_CANDIDATE").otherwise(weaker))
    )


def extraction_mode(kind: Column, share: Column, n_boxes: Column, has_text: Column, band_usable: Column, min_share: float = 0.5) -> Column:
    cat = (
        F.when(has_text & band_usable, "HYBRID_EVIDENCE")
        .when(has_text, "INDIVIDUAL_ONLY")
        .when(band_usable, "BAND_ONLY")
        .otherwise("FAILED")
    )
    rest = (
        F.when((n_boxes > 0) & (share >= min_share), "INDIVIDUAL")
        .when(band_usable, "BAND_FALLBACK")
        .when(has_text, "INDIVIDUAL_PARTIAL")
        .otherwise("FAILED")
    )
    return F.when(kind == "categorical", cat).otherwise(rest)


def color_labels(no_mark: Column, missing: Column, extra: Column, variation: Column, deviation: Column) -> Column:
    parts = F.array_compact(
        F.array(
            *[
                F.when(c == 1, F.lit(n))
                for c, n in (
                    (missing, "MISSING_COLOR"), (extra, "EXTRA_COLOR"),
                    (variation, "INTERNAL_VARIATION"), (deviation, "COLOR_DEVIATION"),
                )
            ]
        )
    )
    return F.when(no_mark == 1, "NO_MARK").when(F.size(parts) == 0, "MATCH").otherwise(F.array_join(parts, "+"))


def count_status(observed: Column, extra: Column, missing: Column) -> Column:
    return F.when(observed == 0, "NO_MARK").when(extra > 0, "EXTRA").when(missing > 0, "MISSING").otherwise("EXACT")


def value_band(v: Column) -> Column:
    out = F.when(v <= VALUE_BANDS[0][0], VALUE_BANDS[0][1])
    for limit, name in VALUE_BANDS[1:]:
        out = out.when(v <= limit, name)
    return F.when(v.isNotNull(), out.otherwise(VALUE_BAND_TOP))


def abbreviate(v: Column, prefix: str = "", below_million: str | None = None) -> Column:
    """``12M`` / ``34K`` / ``5``; ``below_million`` replaces everything under one million (zero stays ``0``)."""

    def whole(d: int) -> Column:
        return F.floor(v / F.lit(float(d))).cast("bigint").cast("string")

    millions = F.concat(whole(1_000_000), F.lit("M"))
    if below_million is not None:
        text = F.when(v >= 1_000_000, millions).when(v == 0, "0").otherwise(below_million)
    else:
        text = F.when(v >= 1_000_000, millions).when(v >= 1_000, F.concat(whole(1_000), F.lit("K"))).otherwise(whole(1))
    return F.concat(F.lit(prefix), text)


def numeric_coherence(status: Column, n: Column) -> Column:
    up = _up(status)
    return (
        F.when(up.startswith("COHERENT") & (n >= 2), 1.0)
        .when(up.contains("PARTIAL") & (n >= 2), 0.65)
        .when(n >= 3, 0.5)
        .otherwise(0.0)
    )


def band_strength(status: Column, usable: Column, n: Column) -> Column:
    return (
        F.when((_up(status) == "FOUND") & (n >= 2), 1.0)
        .when((usable == 1) & (n >= 1), 0.75)
        .when(n >= 2, 0.6)
        .otherwise(0.0)
    )


def orientation(x_cat: Column, x_num: Column, y_cat: Column, y_num: Column, y_coh: Column, x_band: Column, v_geo: Column, h_geo: Column) -> Column:
    vertical = 0.38 * x_cat + 0.32 * F.greatest(y_num, y_coh) + 0.15 * x_band + 0.15 * v_geo
    horizontal = 0.43 * y_cat + 0.37 * x_num + 0.20 * h_geo
    unclear = (F.greatest(vertical, horizontal) < 0.48) | (F.abs(vertical - horizontal) < ORIENTATION_MARGIN)
    return F.struct(
        vertical.alias("vertical"),
        horizontal.alias("horizontal"),
        F.when(unclear, "AMBIGUOUS").when(vertical > horizontal, "VERTICAL").otherwise("HORIZONTAL").alias("orientation"),
        F.when(unclear, "").when(vertical > horizontal, "X").otherwise("Y").alias("categorical_axis"),
    )


def ridge_present(support: Column, run: Column) -> Column:
    return F.coalesce((support >= RIDGE_SUPPORT_MIN) | (run >= RIDGE_RUN_MIN), F.lit(False)).cast("int")


def family_type(encoding: Column) -> Column:
    return (
        F.when(encoding == "SOLID_CANDIDATE", "SOLID")
        .when(encoding == "INSUFFICIENT_POINTS", "INSUFFICIENT")
        .when(encoding.isin(*[f"{k}_SCALE_CANDIDATE" for k in ("BRIGHTNESS", "SATURATION", "MIXED")]), "VARIATION")
        .otherwise(F.coalesce(F.when(encoding != "", encoding), F.lit("UNKNOWN")))
    )


def scale_vote_weight(conf: Column) -> Column:
    return F.when(conf.isNull() | F.isnan(conf) | (conf <= 20.0), 0.0).otherwise(F.least(F.lit(1.0), (conf - 20.0) / 70.0))


def overall_strict(dimensions: list[Column]) -> Column:
    """Spec conflict, then any failure, then any open dimension, else conforming.

    A dimension the specification does not fix (``NOT_SPECIFIED``) neither fails nor opens an image.
    """
    vals = F.array(*[F.coalesce(d, F.lit(U)) for d in dimensions])
    return (
        F.when(F.array_contains(vals, U_SPEC), U_SPEC)
        .when(F.array_contains(vals, NC), NC)
        .when(F.exists(vals, lambda v: ~v.isin(C, "NOT_SPECIFIED")), U)
        .otherwise(C)
    )
