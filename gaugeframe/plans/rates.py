"""Counts, rates, roll-ups, confusion matrices and design checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import status as S
from gaugeframe.functions.color import PALETTE
from gaugeframe.functions.numbers import count_where, ratio, rint_round
from gaugeframe.operators import color_match as CM
from gaugeframe.operators import color_rollup as CR
from gaugeframe.operators import integrate as I
from gaugeframe.operators import rates as R
from gaugeframe.plans.catalog import query
from gaugeframe.plans.colors import NAMED_SQL, pair_sql
from gaugeframe.plans.fixtures import IMAGES, UNIT, Derived, hex_of, hex_sql, image_facts, r6, table, units, with_
from gaugeframe.plans.joins import INTEGRATED, integrated
from gaugeframe.plans.rules import COLOR_IMG, FLAG_SQL, FOUR_SQL, MANUALS, STATUS_SQL, SUP_ROWS, color_flag_rows


@query("select coalesce(status, 'PENDING') as status, count(*) as n from (select case when o_orderstatus <> 'P' then o_orderstatus end as status from orders) group by 1")
def d01_status_counts(spark, sf):
    o = table(spark, sf, "orders").selectExpr("case when o_orderstatus <> 'P' then o_orderstatus end as status")
    return R.status_counts(o, "status", "PENDING")


# ------------------------------------------------------------------------------------ mark presence
MARK_AGG = f"""count(*) as n_images, cast(sum(mark_present) as bigint) as n_mark_present, count(*) filter (where mark_present = 0) as n_mark_absent,
  {r6('sum(mark_present) / count(*)')} as p_mark_present, {r6('(count(*) - sum(mark_present)) / count(*)')} as p_mark_absent, {r6('sum(presence_confidence) / count(presence_confidence)')} as presence_confidence_mean"""


@query(with_(*IMAGES, select=f"select unit_id, min(profile) as profile, {MARK_AGG}, {r6('quantile_cont(presence_confidence, 0.5)')} as presence_confidence_median, min(presence_confidence) as presence_confidence_min from image group by unit_id"))
def d02_mark_units(spark, sf):
    per_unit = R.mark_units(image_facts(spark, sf), "unit_id")
    return I.attach(per_unit, units(spark, sf), "unit_id", ["profile"])


def sets_sql(sets, agg):
    """One grouped select per set; the level column names the grouping."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return " union all ".join(
        "select " + ", ".join(c if c in s else f"null as {c}" for c in cols) + f", '{'+'.join(s)}' as level, {agg} from image group by " + ", ".join(s)
        for s in sets
    )


def unit_partials(spark, sf, m):
    """Facts summed per unit, then joined with the unit attributes: the join sees units, not images."""
    return m.partial(image_facts(spark, sf), "unit_id").join(units(spark, sf), "unit_id", "left")


GROUPS = [["profile"], ["condition_code"], ["task"], ["technique"]]


@query(with_(*IMAGES, select=sets_sql(GROUPS, MARK_AGG)))
def d03_mark_group_summary(spark, sf):
    m = R.mark_measures()
    return m.by_sets(unit_partials(spark, sf, m), GROUPS)


# ------------------------------------------------------------------------------------ axis presence
def axis_agg() -> str:
    parts = {"x": ("x_eval = 1", "x_present = 1"), "y": ("y_eval = 1", "y_present = 1"), "both": ("x_eval = 1 and y_eval = 1", "x_present = 1 and y_present = 1")}
    out = ["count(*) as n_images"]
    for n, (can, has) in parts.items():
        k, d = f"count(*) filter (where {can} and {has})", f"count(*) filter (where {can})"
        out += [f"{d} as n_{n}_evaluable", f"{k} as n_{n}_present", f"{r6(f'{k} / nullif({d}, 0)')} as p_{n}_present"]
    return ", ".join(out + ["count(*) filter (where not (x_eval = 1 and y_eval = 1)) as n_unevaluable"])


@query(with_(*IMAGES, select=f"select unit_id, min(profile) as profile, {axis_agg()} from image group by unit_id"))
def d04_axis_units(spark, sf):
    m = R.axis_measures()
    return I.attach(m.finish(m.partial(image_facts(spark, sf), "unit_id")), units(spark, sf), "unit_id", ["profile"])


@query(with_(*IMAGES, select=sets_sql(GROUPS, axis_agg())))
def d05_axis_group_summary(spark, sf):
    m = R.axis_measures()
    return m.by_sets(unit_partials(spark, sf, m), GROUPS)


# ----------------------------------------------------------------------------------- label presence
_B = "x_present = 1 and y_present = 1 and x_eval = 1 and y_eval = 1"
LABEL_AGG = f"""count(*) as n_images, count(*) filter (where x_present = 1) as n_x_present, count(*) filter (where y_present = 1) as n_y_present, count(*) filter (where {_B}) as n_both_present,
  count(*) filter (where needs_review = 1) as n_review, count(*) filter (where x_eval = 1) as n_x_seg_ok, count(*) filter (where y_eval = 1) as n_y_seg_ok,
  {r6('100 * count(*) filter (where x_present = 1) / count(*)')} as pct_x_present, {r6('100 * count(*) filter (where y_present = 1) / count(*)')} as pct_y_present, {r6(f'100 * count(*) filter (where {_B}) / count(*)')} as pct_both_present"""
LABEL_SETS = [*GROUPS, ["profile", "condition_code"]]


@query(with_(*IMAGES, select=sets_sql(LABEL_SETS, LABEL_AGG)))
def d06_ticklabel_group_summary(spark, sf):
    m = R.label_measures()
    return m.by_sets(unit_partials(spark, sf, m), LABEL_SETS)


@query(with_(*IMAGES, f"u as (select unit_id, profile, technique, task, condition_code, participant_id, {LABEL_AGG} from image group by all)",
             select="select *, case when n_x_present = n_images then 1 else 0 end as all_x_present, case when n_y_present = n_images then 1 else 0 end as all_y_present, case when n_both_present = n_images then 1 else 0 end as all_both_present from u"))
def d07_ticklabel_units(spark, sf):
    m = R.label_measures()
    return R.all_repeats(m.finish(unit_partials(spark, sf, m)))


SUP_VALUES = ["STRONG_CANDIDATE", "PARTIAL_CANDIDATE", "MULTI_EVIDENCE", "SINGLE_EVIDENCE", "FAIL_CANDIDATE"]
SEL_VALUES = ["COHERENT_DIRECT", "SELECTED_BY_COHERENCE", "PARTIAL_UNREADABLE", "AMBIGUOUS", "INSUFFICIENT"]


@query(with_(SUP_ROWS.cte, select="select substr(kind,1,1) as profile, orientation as axis, count(*) as n_axes, min(kind) as kind, " + ", ".join(f"count(*) filter (where support = '{v}') as n_{v.lower()}" for v in SUP_VALUES) + ", " + ", ".join(f"count(*) filter (where selection = '{v}') as n_{v.lower()}" for v in SEL_VALUES) + " from s group by all"))
def d08_axis_summary_automatic(spark, sf):
    s = SUP_ROWS.spark(spark, sf).withColumns({"profile": F.substring("kind", 1, 1), "axis": F.col("orientation")})
    return s.groupBy("profile", "axis").agg(
        F.count(F.lit(1)).alias("n_axes"),
        F.min("kind").alias("kind"),
        *[count_where(F.col("support") == v).alias(f"n_{v.lower()}") for v in SUP_VALUES],
        *[count_where(F.col("selection") == v).alias(f"n_{v.lower()}") for v in SEL_VALUES],
    )


# ------------------------------------------------------------------------------------------- colour
UNIT_COLOR = Derived("c0", "lineitem", {
    "unit_id": "l_orderkey", "dmax": "case when l_linenumber <> 4 then l_discount * 37 end", "dmean": "case when l_linenumber <> 4 then l_discount * 21 end", "n_expected": "2",
    "n_matched": "l_linenumber % 3", "n_extra": "l_suppkey % 3", "n_observed": "l_linenumber % 3 + l_suppkey % 3", "n_missing": "2 - l_linenumber % 3",
    "extraction_status": "case when l_linenumber % 3 + l_suppkey % 3 = 0 then 'NO_MARK' else 'OK' end", "internal_variation": "case when l_partkey % 4 = 0 then 1 else 0 end",
    "n_overlap_derived": "case when l_partkey % 5 <> 0 then l_partkey % 3 end", "support": "l_tax * 10", "point_max": "case when l_partkey % 2 = 0 then l_quantity end", "point_p90": "case when l_partkey % 2 = 0 then l_quantity * 0.75 end",
})
REPEATS = 4
RAW_RATES = {"extra": "n_extra > 0", "missing": "n_missing > 0", "exact_count": "n_observed > 0 and n_extra = 0 and n_missing = 0", "complete": "n_matched = n_expected", "no_mark": "extraction_status = 'NO_MARK'",
             "internal_variation": "internal_variation = 1", "line_overlap_derived": "n_overlap_derived > 0"}


@query(with_(UNIT_COLOR.cte, select=f"select unit_id, count(*) as n_repeats_found, {REPEATS}::bigint as expected_repeats, case when count(*) = {REPEATS} then 1 else 0 end as repeats_complete, count(dmax) as n_color_evaluable, {r6('avg(n_matched / n_expected)')} as completeness, "
             + ", ".join(f"{r6(f'avg({d})')} as {d}_mean, {r6(f'median({d})')} as {d}_median, {r6(f'quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25)')} as {d}_iqr" for d in ("dmax", "dmean"))
             + f", {r6('max(dmax)')} as dmax_max, " + ", ".join(f"{r6(f'count(*) filter (where {c}) / count(*)')} as p_{n}" for n, c in RAW_RATES.items())
             + ", " + ", ".join(f"{r6(f'avg(n_{c})')} as {c}_colors_mean" for c in ("observed", "extra", "missing"))
             + f", {r6('avg(support)')} as support_mean, {r6('min(support)')} as support_min, {r6('avg(point_max)')} as point_max_mean, {r6('avg(point_p90)')} as point_p90_mean from c0 group by unit_id"))
def d09_color_units_raw(spark, sf):
    return CR.raw_unit_rollup(UNIT_COLOR.spark(spark, sf), "unit_id", REPEATS)


RATE_COLS = ["strict_match", "color_deviation", "missing_color", "semantic_extra", "near_duplicate", "no_mark", "internal_variation", "overlap_derived"]
COLOR_ST = (COLOR_IMG.cte, FLAG_SQL, f"st0 as (select *, {STATUS_SQL} as color_status from fl)",
            "st as (select st0.*, case when color_status = 'MATCH' then 1 else 0 end as strict_match, o_custkey as unit_id from st0 join orders on o_orderkey = filename)")


def color_with_unit(spark, sf):
    from gaugeframe.plans.fixtures import table as t

    exprs = {**COLOR_IMG.exprs, "unit_id": "o_custkey"}
    df = t(spark, sf, "orders").selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])
    return CR.color_flags(df)


@query(with_(*COLOR_ST, "w as (select unit_id, string_agg(color_status || ':' || n, '|' order by color_status || ':' || n) as status_distribution from (select unit_id, color_status, count(*) as n from st group by all) group by unit_id)",
             select=f"""select unit_id, count(*) as n_images, cast(sum(color_evaluable) as bigint) as n_evaluable, {r6('avg(dmax)')} as dmax_mean, {r6('median(dmax)')} as dmax_median,
   {r6('quantile_cont(dmax,0.75) - quantile_cont(dmax,0.25)')} as dmax_iqr, {r6('max(dmax)')} as dmax_max, """ + ", ".join(f"{r6(f'avg({c})')} as p_{c}" for c in RATE_COLS) +
             """, cast(sum(n_near) as bigint) as near_duplicate_total, cast(sum(n_semantic) as bigint) as semantic_extra_total, cast(coalesce(sum(try_cast(n_missing as double)), 0) as bigint) as missing_total, min(status_distribution) as status_distribution
   from st join w using (unit_id) group by unit_id"""))
def d10_color_units_final(spark, sf):
    return CR.unit_rollup(color_with_unit(spark, sf), "unit_id")


@query(with_(*COLOR_ST, UNIT, select=f"""select profile, count(*) as n_images, count(*) filter (where color_evaluable = 1) as n_evaluable, cast(sum(strict_match) as bigint) as n_strict_match, {r6('avg(strict_match)')} as p_strict_match_all,
   {r6('avg(strict_match) filter (where color_evaluable = 1)')} as p_strict_match_evaluable, """ + ", ".join(f"cast(sum({c}) as bigint) as n_{c}" for c in RATE_COLS[1:]) +
             f""", {r6('avg(dmax) filter (where color_evaluable = 1)')} as dmax_mean_evaluable, {r6('median(dmax) filter (where color_evaluable = 1)')} as dmax_median_evaluable, {r6('max(dmax) filter (where color_evaluable = 1)')} as dmax_max_evaluable
   from st left join unit using (unit_id) group by profile"""))
def d11_color_profile_summary(spark, sf):
    flags = I.attach(color_with_unit(spark, sf), units(spark, sf), "unit_id", ["profile"])
    return CR.profile_rollup(flags)


EXTRAS = Derived("x", "lineitem", {"filename": "l_orderkey", "observed_index": "l_partkey * 100 + l_linenumber", "extra_class": "case when l_discount <= 0.03 then 'NEAR_DUPLICATE' else 'SEMANTIC_EXTRA_CANDIDATE' end", "support": "l_tax"})


@query(with_("x as (select l_orderkey as filename, l_partkey * 100 + l_linenumber as observed_index, case when l_discount <= 0.03 then 'NEAR_DUPLICATE' else 'SEMANTIC_EXTRA_CANDIDATE' end as extra_class, l_tax as support, " + hex_sql("l_partkey") + " as observed_hex from lineitem)",
             """g as (select filename, count(*) filter (where extra_class = 'NEAR_DUPLICATE') as n_near_duplicate, count(*) filter (where extra_class <> 'NEAR_DUPLICATE') as n_extra_semantic_candidate,
   coalesce(string_agg(observed_hex, '|' order by observed_index) filter (where extra_class = 'NEAR_DUPLICATE'), '') as near_duplicate_hex, coalesce(string_agg(observed_hex, '|' order by observed_index) filter (where extra_class <> 'NEAR_DUPLICATE'), '') as semantic_extra_hex,
   min(support) filter (where extra_class <> 'NEAR_DUPLICATE') as semantic_extra_support_min from x group by filename)""",
             select="""select o_orderkey as filename, coalesce(n_near_duplicate, 0) as n_near_duplicate, coalesce(n_extra_semantic_candidate, 0) as n_extra_semantic_candidate, coalesce(near_duplicate_hex, '') as near_duplicate_hex,
   coalesce(semantic_extra_hex, '') as semantic_extra_hex, semantic_extra_support_min from orders left join g on filename = o_orderkey"""))
def d12_extra_summary(spark, sf):
    exprs = {**EXTRAS.exprs, "observed_hex": hex_of("l_partkey")}
    x = table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])
    g = CR.extra_summary(x)
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"))
    return base.join(g, "filename", "left").na.fill(0, ["n_near_duplicate", "n_extra_semantic_candidate"]).na.fill("", ["near_duplicate_hex", "semantic_extra_hex"])


# ------------------------------------------------------------------------------ scores, pivots
SCORES = Derived("sc", "orders", {"participant": "o_custkey % 40", "condition": "o_orderstatus", "task": "case when o_orderkey % 2 = 0 then 'B-ID' else 'B-COMP' end", "ocr": "case when o_orderkey % 29 <> 0 then cast(o_orderkey * 7919 % 10007 as double) / 10007 end", "clip": "cast(o_orderkey * 104729 % 10009 as double) / 10009"})
SCORE_SUM = (SCORES.cte, "ex as (select participant, condition, task, round_even(ocr * 100.0, 0) as ocr, round_even(clip * 100.0, 0) as clip from sc)")
SC_CONDS = ["F", "O", "P"]
SC_TASKS = ["B-COMP", "B-ID"]


@query(with_(*SCORE_SUM, select=f"select participant, condition, task, {r6('avg(ocr) / 100.0')} as ocr, {r6('avg(clip) / 100.0')} as clip from ex group by all"))
def d16_participant_summary(spark, sf):
    from gaugeframe.operators.score_export import participant_summary

    return participant_summary(SCORES.spark(spark, sf)).select("participant", "condition", "task", rint_round(F.col("ocr")).alias("ocr"), rint_round(F.col("clip")).alias("clip"))


@query(with_(*SCORE_SUM, "su as (select participant, condition, task, avg(ocr) / 100.0 as ocr from ex group by all)",
             select="select participant, " + ", ".join(f"round_even(avg(ocr) filter (where condition = '{c}' and task = '{t}') * 100.0, 0) / 100.0 as \"{c}_{t}\"" for c in SC_CONDS for t in SC_TASKS) + " from su group by participant"))
def d17_pivot_scores(spark, sf):
    from gaugeframe.operators.score_export import participant_summary, score_pivot

    return score_pivot(participant_summary(SCORES.spark(spark, sf)), "ocr", SC_CONDS, SC_TASKS)


# ------------------------------------------------------------------------------ validation
VALID = (MANUALS.cte, f"f as (select *, {FOUR_SQL} as manual4 from m)", "vd as (select *, case when manual4 = 'UNEVALUABLE' then 'UNEVALUABLE' when observed = manual4 then 'MATCH' else 'MISMATCH' end as match from f)")


def validated(spark, sf):
    m = MANUALS.spark(spark, sf).withColumn("manual4", S.four_class(F.col("manual")))
    return m.withColumn("match", S.validation_match(F.col("manual4"), F.col("observed")))


@query(with_(*VALID, select="select manual4 as manual, " + ", ".join(f"count(*) filter (where observed = '{c}') as \"{c}\"" for c in S.FOUR_CLASSES) + ", count(*) as \"TOTAL\" from vd where manual4 <> 'UNEVALUABLE' group by manual4"))
def d18_confusion_matrix(spark, sf):
    return R.confusion(validated(spark, sf).where(F.col("manual4") != S.U), "manual4", "observed", S.FOUR_CLASSES)


@query(with_(*VALID, select=f"select count(*) filter (where match = 'MATCH') as n_match, count(*) filter (where match = 'MISMATCH') as n_mismatch, count(*) filter (where match = 'UNEVALUABLE') as n_unevaluable, {r6('''count(*) filter (where match = 'MATCH') / count(*) filter (where match <> 'UNEVALUABLE')''')} as accuracy from vd"))
def d19_accuracy_evaluable(spark, sf):
    return R.accuracy(validated(spark, sf), "match")


@query("select l_returnflag, " + ", ".join(f"count(*) filter (where l_linestatus = '{v}') as \"n_{v}\", {r6(f'''100 * count(*) filter (where l_linestatus = '{v}') / count(*)''')} as \"pct_{v}\"" for v in ("F", "O")) + " from lineitem group by l_returnflag")
def d20_crosstab_with_pct(spark, sf):
    return R.row_shares(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query(with_(MANUALS.cte, "k as (select substr(o_orderpriority, 1, 1) as profile, observed from m join orders on o_orderkey = filename)",
             select=" union all ".join(f"select {p} as profile, " + ", ".join(f"count(*) filter (where observed = '{c}') as \"{c}\"" for c in S.FOUR_CLASSES) + f" from k{g}" for p, g in (("profile", " group by profile"), ("'ALL'", "")))))
def d21_observed_by_profile(spark, sf):
    df = table(spark, sf, "orders").selectExpr("substr(o_orderpriority, 1, 1) as profile", f"{MANUALS.exprs['observed']} as observed")
    return R.observed_by(df, "profile", "observed", S.FOUR_CLASSES)


@query(f"""select count(*) as n, count(*) filter (where l_quantity < 0) as n_failed, case when count(*) filter (where l_quantity < 0) = 0 then {r6('1 - pow(0.05, 1 / count(*))')} end as upper_bound from lineitem""")
def d23_zero_failure_upper_bound(spark, sf):
    return R.zero_failure_bound(table(spark, sf, "lineitem"), F.col("l_quantity") < 0)


BARS = {"filename": "l_orderkey", "pixels": "cast(l_quantity as bigint)", "support_exact": "l_discount", "support_near": "l_discount + l_tax"}


@query(with_(f"b as (select {', '.join(f'{e} as {n}' for n, e in BARS.items())}, {hex_sql('l_partkey % 5')} as hex from lineitem)", NAMED_SQL,
             "h as (select hex, place, color_name, color_hex from (select distinct hex from b) cross join pal)", *pair_sql("h", "hex", "color_hex", "d", "hd"),
             "nn as (select * from hd qualify row_number() over (partition by hex order by d, place) = 1)",
             f"""g as (select filename, hex, count(*) as n_bars, cast(sum(pixels) as bigint) as pixel_sum, {r6('avg(support_exact)')} as support_exact_mean, {r6('min(support_exact)')} as support_exact_min,
   {r6('avg(support_near)')} as support_near_mean, {r6('min(support_near)')} as support_near_min, row_number() over (partition by filename order by sum(pixels) desc, hex) as color_rank from b group by filename, hex)""",
             select=f"select g.*, color_name as nearest_name, color_hex as nearest_hex, {r6('d')} as delta_e from g join nn using (hex)"))
def d24_distinct_colors(spark, sf):
    b = table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in BARS.items()], f"{hex_of('l_partkey % 5')} as hex")
    return CM.distinct_colors(b, "filename", "hex", PALETTE)


@query("select o_custkey as unit_id, count(*) as n from orders group by 1 having count(*) <> 10")
def d25_design_balance(spark, sf):
    return R.balance(table(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id")), ["unit_id"], 10)


# published image counts of the colour dimension; other data differs from them, which the flag shows
GOLDEN_COLOR = [("CONFORMING", 2816), ("NONCONFORMING", 289), ("UNEVALUABLE", 15)]


@query(with_(*INTEGRATED, "golden as (select * from (values " + ", ".join(f"('{s}', {n}::bigint)" for s, n in GOLDEN_COLOR) + ") v(status, expected_n))",
             "found as (select color_status as status, count(*) as n from integrated group by 1)", select="select golden.status, expected_n, coalesce(n, 0) as n, coalesce(n, 0) = expected_n as ok from golden left join found using (status)"))
def d26_golden_checks(spark, sf):
    golden = spark.createDataFrame(GOLDEN_COLOR, "status string, expected_n bigint")
    found = R.status_counts(integrated(spark, sf).withColumnRenamed("color_status", "status"), "status")
    return I.golden_checks(found, golden, ["status"], "n")


@query(f"select l_discount as rate, {r6('sum(l_extendedprice)')} as operation, cast(sum(l_quantity) as bigint) as disbursed from lineitem group by l_discount")
def d27_group_sum_by_key(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_discount").alias("rate")).agg(rint_round(F.sum("l_extendedprice")).alias("operation"), F.sum("l_quantity").cast("bigint").alias("disbursed"))


@query(with_(*IMAGES, select=f"""select profile, count(*) filter (where mark_present = 0) as n_controls, count(*) filter (where mark_present = 0 and x_present = 0) as n_absent,
   {r6('count(*) filter (where mark_present = 0 and x_present = 0) / nullif(count(*) filter (where mark_present = 0), 0)')} as absent_rate from image group by profile"""))
def d28_negative_control_rate(spark, sf):
    control = F.col("mark_present") == 0
    facts = image_facts(spark, sf).groupBy("unit_id").agg(count_where(control).alias("c"), count_where(control & (F.col("x_present") == 0)).alias("a"))
    j = I.attach(facts, units(spark, sf), "unit_id", ["profile"])
    return j.groupBy("profile").agg(F.sum("c").alias("n_controls"), F.sum("a").alias("n_absent"), ratio(F.sum("a"), F.sum("c")).alias("absent_rate"))
