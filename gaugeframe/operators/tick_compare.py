"""Comparison of observed axis content with its specification (the flagship job).

Observation tables never carry the specification; it is joined here, once, on (unit, axis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import text as T
from gaugeframe.functions.numbers import count_where, fixed_rows, ratio, rint_round
from gaugeframe.operators import multiset
from gaugeframe.operators.rates import grouped_sets

KINDS = ["categorical", "temporal", "numeric"]

# --- fixed values -------------------------------------------------------------------------------
NORMALIZATION = "B_B_NORMALIZATION_V1"
BATCHES = {"categorical": "BA_CAT_PRODUCTION", "other": "BA_V7_PRODUCTION"}
REASONS = {
    "categorical": {
        "scope": "F não define lista categórica exaustiva.", "review": "F requer adjudicação.", "unread": "B-A não fornece conteúdo completo adjudicável.",
        "same": "Conteúdo categórico coincide após normalização congelada.", "different": "Diferença lexical/conteúdo não autorizada pela normalização.",
    },
    "temporal": {"unread": "B-A temporal sem lista utilizável.", "same": "Sequência temporal corresponde à F.", "different": "Ano(s) ausente(s)/adicional(is) em relação à lista exaustiva."},
    "numeric": {"unread": "B-A numérica sem conteúdo completo utilizável.", "same": "Conteúdo numérico coincide após normalização determinística.", "different": "Conteúdo numérico difere de F; nenhuma tolerância fuzzy foi aplicada."},
    "other": {"examples": "F fornece apenas exemplos; completude não é pontuada.", "scope": "F não define lista exaustiva.", "review": "A própria F requer adjudicação antes da B-B.", "not_ready": "Combinação ainda não operacionalizada."},
}
# ------------------------------------------------------------------------------------------------


def spec_numbers(part: Column) -> Column:
    """One specification item as ``STRUCT<typ,value>``."""
    p = F.trim(part)
    pct = p.endswith("%")
    bare = F.trim(F.regexp_replace(p, "%$", "")).cast("double")
    return F.struct(F.when(pct, "PCT").otherwise("NUM").alias("typ"), F.when(pct, bare).otherwise(rint_round(bare)).alias("value"))


def number_and_unit(part: Column) -> Column:
    """First number with its unit word as ``STRUCT<value,unit>``, NULL when there is none."""

    def read(plain: Column) -> Column:
        number = F.regexp_extract(plain, T.NUMBER_UNIT, 1)
        found = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
        return T.let(found, lambda value: F.when(value.isNotNull(), F.struct(value.alias("value"), F.regexp_extract(plain, T.NUMBER_UNIT, 2).alias("unit"))))

    return T.let(T.norm_text(part), read)


def _parts(c: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), r"\|"), lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: p != "")


def dominant_unit(raw: Column) -> Column:
    """Most frequent unit word of the raw reading, the first seen among equals, blank if none."""

    def most(seen: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(seen),
            lambda u: F.struct(
                F.size(F.filter(seen, lambda s: s == u)).alias("n"), (-F.array_position(seen, u)).alias("first"), u.alias("u")
            ),
        )
        return F.coalesce(F.array_max(ranked)["u"], F.lit(""))

    plain = T.let(F.coalesce(raw, F.lit("")), T.norm_text)
    return T.let(F.regexp_extract_all(plain, F.lit(T.RAW_UNIT), F.lit(1)), most)


def canonical(pairs: Column) -> Column:
    """``ARRAY<STRUCT<value,unit>>`` to ``ARRAY<STRUCT<typ,value>>``."""

    def one(p: Column, m: Column) -> Column:
        return F.struct(
            F.when(m.isNull(), "PCT").otherwise("NUM").alias("typ"),
            F.when(m.isNull(), rint_round(p["value"], 9)).otherwise(rint_round(p["value"] * m, 6)).alias("value"),
        )

    return F.transform(pairs, lambda p: T.let(T.unit_multiplier(p["unit"]), lambda m: one(p, m)))


def _with_unit(pairs: Column, unit: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), F.when(p["value"] == 0, "").otherwise(unit).alias("unit")))


def _numbers(c: Column) -> Column:
    found = F.transform(_parts(c), lambda p: F.struct(p.try_cast("double").alias("value"), F.lit("").alias("unit")))
    return F.filter(found, lambda p: p["value"].isNotNull())


def observed_numeric(df: DataFrame, manual: str, effective: str, selected: str, raw: str) -> DataFrame:
    """Add the best numeric reading as ``source, display, items``.

    A manual reading wins over validated values, those over selected values with the dominant unit.
    Built in steps, so every intermediate list is computed once.
    """
    keep = df.columns
    d = df.withColumns({
        "__unit": dominant_unit(F.col(raw)),
        "__typed": F.filter(F.transform(_parts(F.col(manual)), number_and_unit), lambda p: p.isNotNull()),
        "__checked": _numbers(F.col(effective)),
        "__picked": _numbers(F.col(selected)),
    })
    unitless = ~F.exists("__typed", lambda p: (p["value"] != 0) & (p["unit"] != ""))
    by_hand, checked, picked = (F.size(c) > 0 for c in ("__typed", "__checked", "__picked"))
    unit = F.col("__unit")
    pairs = (
        F.when(by_hand, F.when(unitless & (unit != ""), _with_unit(F.col("__typed"), unit)).otherwise(F.col("__typed")))
        .when(checked, F.col("__checked"))
        .otherwise(_with_unit(F.col("__picked"), unit))
    )
    blank = F.lit("")
    d = d.withColumn("__pairs", pairs)
    return d.select(
        *keep,
        F.when(by_hand, "MANUAL_ADJUDICATED").when(checked, "AUTO_VALIDATED").when(picked, "AUTO_FALLBACK").otherwise("NONE").alias("source"),
        F.when(by_hand, F.trim(manual)).when(checked, F.coalesce(selected, blank)).when(picked, F.trim(selected)).otherwise(blank).alias("display"),
        canonical(F.col("__pairs")).alias("items"),
    )


# ---------------------------------------------------------------------------------- decision table
def gate(kind: Column, scope: Column, status: Column, eligible: Column, has_observed: Column) -> Column:
    """Why a row is not compared, NULL when it is (first match wins)."""
    review = status.startswith("REVIEW_")
    cat = (
        F.when(scope != "EXHAUSTIVE", "NOT_EVALUATED")
        .when(review, "UNEVALUABLE_SPEC_REVIEW")
        .when(eligible != "YES", "UNEVALUABLE")
    )
    ready = F.when(kind == "temporal", status == "READY_TEMPORAL").otherwise(status.startswith("READY_"))
    rest = (
        F.when(scope.isin("NOT_SPECIFIED", "EXAMPLES_ONLY"), "NOT_EVALUATED")
        .when(review, "UNEVALUABLE_SPEC_REVIEW")
        .when(~ready, "NOT_EVALUATED")
        .when(~has_observed, "UNEVALUABLE")
    )
    return F.when(kind == "categorical", cat).otherwise(rest)


def reason(kind: Column, scope: Column, detailed: Column, compared: Column) -> Column:
    """Why a row has its status, in the words of the reports."""
    cat, rest = REASONS["categorical"], REASONS["other"]

    def content(word: str) -> Column:
        return F.when(kind == "categorical", cat[word]).when(kind == "temporal", REASONS["temporal"][word]).otherwise(REASONS["numeric"][word])

    unscored = (
        F.when(kind == "categorical", cat["scope"]).when(scope == "EXAMPLES_ONLY", rest["examples"])
        .when(scope == "NOT_SPECIFIED", rest["scope"]).otherwise(rest["not_ready"])
    )
    return (
        F.when(compared, F.when(detailed == "NORMALIZED_EQUIVALENT", content("same")).otherwise(content("different")))
        .when(detailed == "NOT_EVALUATED", unscored)
        .when(detailed == "UNEVALUABLE_SPEC_REVIEW", F.when(kind == "categorical", cat["review"]).otherwise(rest["review"]))
        .otherwise(content("unread"))
    )


def collapse(detailed: Column) -> Column:
    return (
        F.when(detailed == "NORMALIZED_EQUIVALENT", "CONFORMING")
        .when(detailed.startswith("NONCONFORMING"), "NONCONFORMING")
        .when(detailed == "NOT_EVALUATED", "NOT_SPECIFIED")
        .otherwise("UNEVALUABLE")
    )


def compare_axes(axes: DataFrame, expected: DataFrame, observed: DataFrame, key: str, value: str, text=None, weight: str | None = None) -> DataFrame:
    """Per axis row: statuses with their reason, differing items, source and denominator membership.

    ``axes`` holds one row per key with ``kind, scope, status, eligible``; ``expected`` and
    ``observed`` are long ``key, value`` tables, the latter with an optional ``weight``.  Everything is keyed by ``key``, so the counts, the
    roll-up and the final join share one hash partitioning.
    """
    counts = multiset.value_counts(expected, observed, [key], value, weight)
    per_key = multiset.compare(counts, [key], value, text)
    joined = axes.join(per_key.drop("collapsed"), key, "left")
    nothing = F.lit(0)
    closed = gate(F.col("kind"), F.col("scope"), F.col("status"), F.col("eligible"), F.coalesce("n_observed", nothing) > 0)
    # a compared row without any expected or observed value is an equal pair of empty lists
    open_status = F.coalesce("detailed", F.lit("NORMALIZED_EQUIVALENT"))
    out = joined.withColumns({
        "bb_detailed_status": F.coalesce(closed, open_status),
        "denominator_eligible": F.when(closed.isNull(), "YES").otherwise("NO"),
        "missing_items": F.when(closed.isNull(), F.coalesce("missing_items", F.lit(""))).otherwise(""),
        "extra_items": F.when(closed.isNull(), F.coalesce("extra_items", F.lit(""))).otherwise(""),
    })
    out = out.withColumns({
        "bb_collapsed_status": collapse(F.col("bb_detailed_status")),
        "bb_reason": reason(F.col("kind"), F.col("scope"), F.col("bb_detailed_status"), F.col("denominator_eligible") == "YES"),
        "source_batch": F.when(F.col("kind") == "categorical", BATCHES["categorical"]).otherwise(BATCHES["other"]),
        "normalization_version": F.lit(NORMALIZATION),
    })
    return out.drop(
        "detailed", "n_expected", "n_observed", "n_missing", "n_extra"
    )


def _beyond(a: Column, b: Column) -> Column:
    """Items of one list beyond their number in another, in ascending order."""
    times = lambda c, v: F.size(F.filter(c, lambda x: x == v))
    return F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda v: F.array_repeat(v, F.greatest(times(a, v) - times(b, v), F.lit(0)))))


def tick_report(spec: DataFrame, categorical: DataFrame, final: DataFrame, axes: DataFrame) -> DataFrame:
    """The full report, one row per categorical image and per temporal or numeric axis, with both lists as text.

    Inputs are separate tables. ``spec``: unit_id, axis, scope, status, display, canonical, x_order.
    ``categorical``: filename, profile, unit_id, condition, extraction_source, ba_final_status, content,
    eligible. ``final``: filename, axis, kind, profile, unit_id, condition, manual, manual_result, years,
    selected; kinds other than temporal and numeric are left out. ``axes``: filename, axis, raw, effective,
    one row per axis. Rows of units without a specification are left out. A list is the text of one cell,
    so lists are compared within their row and only the joins shuffle.
    """
    blank = F.lit("")
    ids = ["filename", "profile", "unit_id", "condition"]
    cat = categorical.select(*ids, F.lit("X").alias("axis"), F.lit("categorical").alias("kind"), "extraction_source", "ba_final_status", "content", "eligible")
    rest = final.where(F.col("kind").isin("temporal", "numeric")).select(*ids, F.upper("axis").alias("axis"), "kind", "manual", "manual_result", "years", "selected")
    rest = rest.join(axes.select("filename", "axis", "raw", "effective"), ["filename", "axis"], "left")
    rows = cat.unionByName(rest, allowMissingColumns=True).join(spec.select("unit_id", "axis", "scope", "status", "display", "canonical", "x_order").withColumnRenamed("display", "wanted"), ["unit_id", "axis"])
    rows = observed_numeric(rows, "manual", "effective", "selected", "raw")
    kind = F.col("kind")
    is_cat, is_num = kind == "categorical", kind == "numeric"
    rows = rows.withColumns({
        "e_text": F.when(~is_num, _parts(F.col("canonical"))),
        "o_text": F.when(is_cat, F.transform(_parts(F.col("content")), T.cat_label)).when(~is_num, _parts(F.col("years"))),
        "e_num": F.when(is_num, F.transform(_parts(F.col("canonical")), spec_numbers)),
        "o_num": F.when(is_num, F.col("items")),
    })
    n_observed = F.size(F.coalesce("o_text", F.array().cast("array<string>"))) + F.when(is_num, F.size("o_num")).otherwise(0)
    rows = rows.withColumn("closed", gate(kind, F.col("scope"), F.col("status"), F.coalesce("eligible", blank), n_observed > 0))
    compared = F.col("closed").isNull()
    reached = compared | (F.col("closed") == "UNEVALUABLE")  # past what the specification leaves open
    rows = rows.withColumns({f"{side}_{of}": F.when(compared, _beyond(F.col(f"{a}_{of}"), F.col(f"{b}_{of}"))) for of in ("text", "num") for side, a, b in (("missing", "e", "o"), ("extra", "o", "e"))})
    number = lambda side: F.when(is_num, F.size(f"{side}_num")).otherwise(F.size(f"{side}_text"))
    detailed = F.coalesce("closed", multiset.detailed_status(number("missing"), number("extra")))
    joined = lambda of: F.coalesce(F.when(is_num, T.typed_numbers(F.col(f"{of}_num"))).otherwise(F.array_join(f"{of}_text", " | ")), blank)
    rows = rows.withColumns({"bb_detailed_status": detailed, "missing_items": joined("missing"), "extra_items": joined("extra"), "read": joined("o")})
    years = F.array_join("o_text", " | ")
    return rows.select(
        *ids, "axis", "kind", F.when(is_cat, BATCHES["categorical"]).otherwise(BATCHES["other"]).alias("source_batch"),
        F.col("scope").alias("f_tick_list_scope"), F.col("status").alias("f_target_status"), F.col("wanted").alias("f_expected_display"), F.col("canonical").alias("f_expected_canonical"),
        F.when(F.col("axis") == "X", F.col("x_order")).otherwise("NOT_SPECIFIED").alias("f_order_required"),
        F.coalesce(F.when(is_cat, F.col("extraction_source")).when(reached & is_num, F.col("source")).when(reached, "AUTO_OR_MANUAL"), blank).alias("ba_source"),
        F.coalesce(F.when(is_cat, F.col("ba_final_status")).when(reached & is_num, F.when(F.col("source") == "NONE", "UNEVALUABLE").otherwise("OBSERVED_COMPLETE")).when(reached, F.col("manual_result")), blank).alias("ba_final_status"),
        F.coalesce(F.when(is_cat, F.col("content")).when(reached & is_num, F.col("display")).when(reached, years), blank).alias("observed_display"),
        F.when(F.when(is_cat, compared).otherwise(reached), F.col("read")).otherwise(blank).alias("observed_canonical"),
        "bb_detailed_status", collapse(F.col("bb_detailed_status")).alias("bb_collapsed_status"), "missing_items", "extra_items",
        reason(kind, F.col("scope"), F.col("bb_detailed_status"), compared).alias("bb_reason"),
        F.when(compared, "YES").otherwise("NO").alias("denominator_eligible"), F.lit(NORMALIZATION).alias("normalization_version"),
    )


def _status_counts() -> list[Column]:
    col = F.col("bb_collapsed_status")
    eligible, good = count_where(F.col("denominator_eligible") == "YES"), count_where(col == "CONFORMING")
    return [
        eligible.alias("eligible"),
        good.alias("conforming"),
        count_where(col == "NONCONFORMING").alias("nonconforming"),
        count_where(col == "UNEVALUABLE").alias("unevaluable"),
        ratio(good, eligible).alias("conformity_rate"),
    ]


def summary_by_kind(results: DataFrame) -> DataFrame:
    """Three rows, one per kind, also where a kind has no rows."""
    scope = F.col("scope")
    agg = results.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(scope == "EXHAUSTIVE").alias("spec_exhaustive"),
        count_where(scope == "EXAMPLES_ONLY").alias("spec_examples_only"),
        count_where(scope == "NOT_SPECIFIED").alias("spec_not_specified"),
        count_where(F.col("bb_detailed_status") == "UNEVALUABLE_SPEC_REVIEW").alias("spec_review"),
        *_status_counts(),
    )
    kinds = fixed_rows(results.sparkSession, "kind", KINDS)
    joined = kinds.join(agg, "kind", "left")
    return joined.na.fill(0, [c for c in agg.columns if c not in ("kind", "conformity_rate")])


def summary_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *_status_counts())


def summaries(results: DataFrame, sets: list[list[str]]) -> DataFrame:
    """All groupings of the final report in one job.

    Rows are counted per finest combination first; the grouping sets only see those counts.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    names = ["n_rows", "eligible", "conforming", "nonconforming", "unevaluable"]
    fine = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *_status_counts()[:-1])
    out = grouped_sets(fine, sets, [F.sum(n).alias(n) for n in names])
    return out.withColumn("conformity_rate", ratio(F.col("conforming"), F.col("eligible")))


def review_cases(results: DataFrame) -> DataFrame:
    return results.where(F.col("bb_collapsed_status").isin("NONCONFORMING", "UNEVALUABLE"))
