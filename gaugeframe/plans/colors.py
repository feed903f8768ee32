"""Colour assignment, extras, families and overlap colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.color import PALETTE
from gaugeframe.functions.numbers import rint_round
from gaugeframe.operators import color_family as CF
from gaugeframe.operators import color_match as CM
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import Derived, hex_of, hex_sql, r6, table, with_


# ------------------------------------------------------------------------- CIEDE2000 as SQL steps
def lab_sql(src: str, hex_col: str, p: str, out: str) -> str:
    """CTE that adds ``{p}_l, {p}_a, {p}_b`` of a hex column to every row of ``src``."""
    chan = ", ".join(f"cast(('0x' || substr({hex_col}, {i}, 2)) as integer) / 255.0::double as {n}0" for i, n in ((2, "r"), (4, "g"), (6, "b")))
    lin = ", ".join(f"case when {n}0 > 0.04045 then pow(({n}0 + 0.055) / 1.055, 2.4) else {n}0 / 12.92 end as {n}1" for n in "rgb")
    xyz = "(r1*0.412453 + g1*0.357580 + b1*0.180423) / 0.95047 as x0, (r1*0.212671 + g1*0.715160 + b1*0.072169) / 1.0 as y0, (r1*0.019334 + g1*0.119193 + b1*0.950227) / 1.08883 as z0"
    f = ", ".join(f"case when {n}0 > 0.008856 then cbrt({n}0) else 7.787 * {n}0 + 16.0/116.0 end as {n}1" for n in "xyz")
    drop = "exclude (r0, g0, b0, r1, g1, b1, x0, y0, z0, x1, y1, z1)"
    return (
        f"{out} as (select * {drop}, 116.0::double * y1 - 16.0 as {p}_l, 500.0::double * (x1 - y1) as {p}_a, 200.0::double * (y1 - z1) as {p}_b "
        f"from (select *, {f} from (select *, {xyz} from (select *, {lin} from (select *, {chan} from {src})))))"
    )


def delta_sql(src: str, p: str, q: str, col: str, out: str) -> str:
    """CTE that adds the colour difference of two Lab triples, written as chained projections."""
    steps = [
        f"(sqrt({p}_a*{p}_a + {p}_b*{p}_b) + sqrt({q}_a*{q}_a + {q}_b*{q}_b)) / 2 as k_cm",
        "1 + 0.5 * (1 - sqrt(pow(k_cm, 7) / (pow(k_cm, 7) + pow(25.0::double, 7)))) as k_g",
        f"{p}_a * k_g as k_a1, {q}_a * k_g as k_a2",
        f"sqrt(k_a1*k_a1 + {p}_b*{p}_b) as k_c1, sqrt(k_a2*k_a2 + {q}_b*{q}_b) as k_c2, "
        f"case when k_a1 = 0 and {p}_b = 0 then 0 else case when degrees(atan2({p}_b, k_a1)) < 0 then degrees(atan2({p}_b, k_a1)) + 360 else degrees(atan2({p}_b, k_a1)) end end as k_h1, "
        f"case when k_a2 = 0 and {q}_b = 0 then 0 else case when degrees(atan2({q}_b, k_a2)) < 0 then degrees(atan2({q}_b, k_a2)) + 360 else degrees(atan2({q}_b, k_a2)) end end as k_h2",
        "case when k_c1 * k_c2 = 0 then 0 when abs(k_h2 - k_h1) <= 180 then k_h2 - k_h1 when k_h2 - k_h1 > 180 then k_h2 - k_h1 - 360 else k_h2 - k_h1 + 360 end as k_dh, "
        "case when k_c1 * k_c2 = 0 then k_h1 + k_h2 when abs(k_h1 - k_h2) <= 180 then (k_h1 + k_h2) / 2 when k_h1 + k_h2 < 360 then (k_h1 + k_h2 + 360) / 2 else (k_h1 + k_h2 - 360) / 2 end as k_hm, "
        f"({p}_l + {q}_l) / 2 as k_lm, (k_c1 + k_c2) / 2 as k_cp",
        "1 - 0.17*cos(radians(k_hm - 30)) + 0.24*cos(radians(2*k_hm)) + 0.32*cos(radians(3*k_hm + 6)) - 0.20*cos(radians(4*k_hm - 63)) as k_t",
        f"({q}_l - {p}_l) / (1 + 0.015*pow(k_lm - 50, 2) / sqrt(20 + pow(k_lm - 50, 2))) as k_dl, (k_c2 - k_c1) / (1 + 0.045*k_cp) as k_dc, "
        "2*sqrt(k_c1*k_c2)*sin(radians(k_dh)/2) / (1 + 0.015*k_cp*k_t) as k_dd, "
        "-2*sqrt(pow(k_cp,7) / (pow(k_cp,7) + pow(25.0::double,7))) * sin(radians(60*exp(-pow((k_hm-275)/25, 2)))) as k_rt",
    ]
    body = f"select * from {src}"
    for s in steps:
        body = f"select *, {s} from ({body})"
    names = "k_cm, k_g, k_a1, k_a2, k_c1, k_c2, k_h1, k_h2, k_dh, k_hm, k_lm, k_cp, k_t, k_dl, k_dc, k_dd, k_rt"
    return f"{out} as (select * exclude ({names}), sqrt(greatest(0, k_dl*k_dl + k_dc*k_dc + k_dd*k_dd + k_rt*k_dc*k_dd)) as {col} from ({body}))"


def pair_sql(src: str, h1: str, h2: str, col: str, out: str) -> tuple[str, str, str]:
    return lab_sql(src, h1, "p", f"{out}_1"), lab_sql(f"{out}_1", h2, "q", f"{out}_2"), delta_sql(f"{out}_2", "p", "q", col, out)


@query(with_(f"s as (select p_partkey, {hex_sql('p_partkey')} as first, {hex_sql('p_size')} as second from part)", *pair_sql("s", "first", "second", "d", "o"), select=f"select p_partkey, first, second, {r6('d')} as delta_e from o"))
def g05_delta_e00(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{hex_of('p_partkey')} as first", f"{hex_of('p_size')} as second")
    return CM.hex_delta(p, "first", "second", "d").withColumn("delta_e", rint_round(F.col("d"))).drop("d")


# ------------------------------------------------------------------------------------- assignment
EXPECT = [("IDENT", 1, PALETTE["vermelho"]), ("COMP", 1, PALETTE["laranja"]), ("COMP", 2, PALETTE["azul"])]
EXPECT_SQL = "expd as (select * from (values " + ", ".join(f"('{p}', {i}, '{h}')" for p, i, h in EXPECT) + ") v(profile, expected_index, expected_hex))"
IMG_SQL = "img as (select o_orderkey as filename, case when o_orderkey % 3 = 0 then 'IDENT' else 'COMP' end as profile from orders)"


def expected_table(spark: SparkSession) -> DataFrame:
    """At most two expected colours per profile: a fixed table, safe to broadcast."""
    rows = ", ".join(f"('{p}', {i}, '{h}')" for p, i, h in EXPECT)
    return spark.sql(f"select * from values {rows} as t(profile, expected_index, expected_hex)")


def observed_rows(spark, sf):
    """Distinct colours of an image; the part key orders them, so no rank is needed."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filename"), "l_partkey").distinct()
    return li.selectExpr("filename", "case when filename % 3 = 0 then 'IDENT' else 'COMP' end as profile", "l_partkey as observed_index", f"{hex_of('l_partkey')} as observed_hex")


def pairs_of(spark, sf):
    img = table(spark, sf, "orders").selectExpr("o_orderkey as filename", "case when o_orderkey % 3 = 0 then 'IDENT' else 'COMP' end as profile")
    return CM.color_pairs(observed_rows(spark, sf), expected_table(spark), img, "filename")


OBS2 = f"obs as (select l_orderkey as filename, case when l_orderkey % 3 = 0 then 'IDENT' else 'COMP' end as profile, l_partkey as observed_index, {hex_sql('l_partkey')} as observed_hex from (select distinct l_orderkey, l_partkey from lineitem))"
# the twin tries every ordered pair of observed colours of an image, as the definition says
ASSIGN = (
    EXPECT_SQL, OBS2, IMG_SQL, "cx as (select obs.*, expected_index, expected_hex from obs join expd using (profile))", *pair_sql("cx", "observed_hex", "expected_hex", "cost", "cs"),
    "c1 as (select filename, observed_index, cost, profile from cs where expected_index = 1)", "c2 as (select filename, observed_index, cost from cs where expected_index = 2)",
    "two as (select a.filename, a.observed_index as i1, b.observed_index as i2 from c1 a join c2 b on a.filename = b.filename and a.observed_index <> b.observed_index qualify row_number() over (partition by a.filename order by a.cost + b.cost, least(a.observed_index, b.observed_index), greatest(a.observed_index, b.observed_index), a.observed_index) = 1)",
    "one as (select filename, expected_index, observed_index from cs where filename not in (select filename from two) qualify row_number() over (partition by filename order by cost, expected_index, observed_index) = 1)",
    "ch as (select filename, 1 as expected_index, i1 as observed_index from two union all select filename, 2, i2 from two union all select * from one)",
    "wa as (select img.filename, expected_index, expected_hex from img join expd using (profile))",
    "sl as (select wa.*, ch.observed_index from wa left join ch using (filename, expected_index))",
    """pr as (select sl.filename, case when obs.observed_hex is null then 'MISSING' else 'MATCHED' end as pair_status, sl.observed_index, obs.observed_hex, sl.expected_index, sl.expected_hex, cost as delta_e
        from sl left join obs on obs.filename = sl.filename and obs.observed_index = sl.observed_index left join cs on cs.filename = sl.filename and cs.observed_index = sl.observed_index and cs.expected_index = sl.expected_index
      union all select filename, 'EXTRA', observed_index, observed_hex, null, null, null from obs where not exists (select 1 from ch where ch.filename = obs.filename and ch.observed_index = obs.observed_index))""",
)


@query(with_(*ASSIGN, select=f"select filename, pair_status, observed_index, observed_hex, expected_index, expected_hex, {r6('delta_e')} as delta_e from pr"))
def g04_min_cost_color_match(spark, sf):
    return pairs_of(spark, sf).drop("chosen").withColumn("delta_e", rint_round(F.col("delta_e")))


EXTRA_CTES = (
    "ex as (select filename, observed_index, observed_hex from pr where pair_status = 'EXTRA')", "ma as (select filename, observed_index as base_index, observed_hex as base_hex from pr where pair_status = 'MATCHED')",
    "nx as (select ex.*, base_index, base_hex from ex join ma using (filename))", *pair_sql("nx", "observed_hex", "base_hex", "d", "nd"),
    "bn as (select * from nd qualify row_number() over (partition by filename, observed_index order by d, base_index) = 1)",
)


@query(with_(*ASSIGN, *EXTRA_CTES, select=f"select ex.filename, ex.observed_index, ex.observed_hex, coalesce(base_hex, '') as nearest_hex, {r6('d')} as delta_e, case when d <= 2.0 then 'NEAR_DUPLICATE' else 'SEMANTIC_EXTRA_CANDIDATE' end as extra_class from ex left join bn using (filename, observed_index)"))
def g06_classify_extras(spark, sf):
    return CM.classify_extras(pairs_of(spark, sf), "filename").withColumn("delta_e", rint_round(F.col("delta_e")))


# what an extraction says of an image besides its colours, and the distances of its scattered points
EXTRACTION = Derived("ext", "orders", {
    "filename": "o_orderkey", "canvas_width": "640 + o_orderkey % 5 * 64", "canvas_height": "480 + o_orderkey % 3 * 60",
    "extraction_status": "case when o_orderkey % 13 = 0 then 'NO_MARK' else 'OK' end", "extraction_support_mean": "case when o_orderkey % 13 <> 0 then cast(o_orderkey % 101 as double) / 128 end",
    "extraction_support_min": "case when o_orderkey % 13 <> 0 then cast(o_orderkey % 101 as double) / 256 end", "n_marks_detected": "case when o_orderkey % 13 <> 0 then o_orderkey % 41 end",
    "n_initial_candidates": "case when o_orderkey % 3 <> 0 then o_orderkey % 59 end", "n_solid_families": "o_orderkey % 4", "n_variable_families": "case when o_orderkey % 6 <> 0 then o_orderkey % 3 end",
    "n_insufficient_families": "case when o_orderkey % 2 = 0 then o_orderkey % 5 end", "legend_suspected_count": "o_orderkey % 2", "n_overlap_derived_families": "case when o_orderkey % 7 = 0 then 1 end",
    "line_derived_hex": "case when o_orderkey % 7 = 0 then concat('#', upper(substr(md5(cast(o_orderkey as string)), 1, 6))) end",
})
POINTS = Derived("pt", "lineitem", {"filename": "l_orderkey", "delta_e": "case when l_linenumber <> 3 then l_discount * 37 end"}, "l_orderkey % 5 <> 0")
COUNTED = ["n_solid_families", "n_variable_families", "n_insufficient_families", "legend_suspected_count", "n_overlap_derived_families"]
NAMED_SQL = "pal as (select * from (values " + ", ".join(f"({i}, '{n}', '{h}')" for i, (n, h) in enumerate(PALETTE.items())) + ") v(place, color_name, color_hex))"


@query(with_(*ASSIGN, EXTRACTION.cte.replace("as string", "as varchar"), POINTS.cte, NAMED_SQL,
             "k as (select filename, count(expected_index) as n_expected, count(observed_hex) as n_observed, count(*) filter (where pair_status = 'MATCHED') as n_matched, count(*) filter (where pair_status = 'EXTRA') as n_extra, count(*) filter (where pair_status = 'MISSING') as n_missing, "
             f"{r6('avg(delta_e)')} as dmean, {r6('median(delta_e)')} as dmedian, {r6('max(delta_e)')} as dmax, coalesce(string_agg(observed_hex, '|' order by expected_index) filter (where pair_status = 'MATCHED'), '') as matched_hex, "
             "coalesce(string_agg(observed_hex, '|' order by observed_index) filter (where observed_hex is not null), '') as observed_hex from pr group by filename)",
             "e as (select img.filename, string_agg(expected_hex, '|' order by expected_index) as expected_hex, string_agg(color_name, '|' order by expected_index) as expected_colors from img join expd using (profile) join pal on color_hex = expected_hex group by 1)",
             f"sp as (select filename, {r6('avg(delta_e)')} as point_mean, {r6('median(delta_e)')} as point_median, {r6('quantile_cont(delta_e, 0.9)')} as point_p90, {r6('max(delta_e)')} as point_max from pt group by 1)",
             select="select ext.* replace (" + ", ".join(f"coalesce({c}, 0) as {c}" for c in COUNTED) + f", coalesce(line_derived_hex, '') as line_derived_hex, {r6('extraction_support_mean')} as extraction_support_mean, {r6('extraction_support_min')} as extraction_support_min), "
             "case when n_variable_families > 0 then 1 else 0 end as internal_variation, k.* exclude (filename), e.expected_hex, e.expected_colors, point_mean, point_median, point_p90, point_max, "
             "case when n_observed = 0 then 'NO_MARK' when n_extra > 0 then 'EXTRA' when n_missing > 0 then 'MISSING' else 'EXACT' end as count_status, abs(n_observed - n_expected) as count_error_abs "
             "from ext left join k using (filename) left join e using (filename) left join sp using (filename)"))
def g07_color_image_rollup(spark, sf):
    return CM.image_report(pairs_of(spark, sf), EXTRACTION.spark(spark, sf), POINTS.spark(spark, sf), "filename", PALETTE)


# --------------------------------------------------------------------------------------- families
# families of supplier markers: few base colours, so equal colours repeat inside a family
MARK_SRC = "select l_suppkey as filename, l_linenumber as family, l_orderkey * 1000000 + l_partkey as marker_id, {hex} as observed_hex from lineitem"
MARK_HEX = "l_partkey % 90 + l_linenumber * 100"


def markers(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_suppkey as filename", "l_linenumber as family", "l_orderkey * 1000000 + l_partkey as marker_id", f"{hex_of(MARK_HEX)} as observed_hex")


FAM = (
    f"mk as ({MARK_SRC.format(hex=hex_sql(MARK_HEX))})",
    "ds as (select filename, family, observed_hex, count(*) as n, min(marker_id) as first_id from mk group by 1, 2, 3)",
    "dp as (select a.filename, a.family, a.observed_hex, a.first_id, b.observed_hex as other, b.n from ds a join ds b on a.filename = b.filename and a.family = b.family)",
    "hp as (select distinct observed_hex, other from dp)", *pair_sql("hp", "observed_hex", "other", "d", "hd"),
    "mm as (select filename, family, observed_hex, first_id, round_even(sum(n * d) / sum(n) * 1e9, 0) / 1e9 as mean, cast(sum(n) as bigint) as n_points from dp join hd using (observed_hex, other) group by 1, 2, 3, 4)",
    f"md as (select filename, family, n_points, observed_hex as medoid_hex, first_id as medoid_id, {r6('mean')} as mean_delta_e from mm qualify row_number() over (partition by filename, family order by mean, first_id) = 1)",
)


@query(with_(*FAM, select="select * from md"))
def g09_family_medoid(spark, sf):
    return CF.family_medoid(markers(spark, sf), ["filename", "family"])


@query(with_(*FAM, *(c for c in (lab_sql("ds", "observed_hex", "c", "dl"),)),
             "jn as (select dl.*, sqrt(c_a*c_a + c_b*c_b) as chroma, medoid_hex, hd.d from dl join md using (filename, family) join hd on hd.observed_hex = medoid_hex and hd.other = dl.observed_hex)",
             "ln as (select jn.* from jn join mk using (filename, family, observed_hex))",
             f"""st as (select filename, family, medoid_hex, count(*) as n_points, {r6('avg(case when d <= 4 then 1 else 0 end)')} as solid_support,
      {r6('case when count(*) <= 3 then max(c_l) - min(c_l) else quantile_cont(c_l, 0.9) - quantile_cont(c_l, 0.1) end')} as l_range, {r6('case when count(*) <= 3 then max(chroma) - min(chroma) else quantile_cont(chroma, 0.9) - quantile_cont(chroma, 0.1) end')} as c_range,
      {r6('median(d)')} as de_median, {r6('max(d)')} as de_max from ln group by 1, 2, 3)""",
             select="""select *, case when n_points = 1 then 'INSUFFICIENT_POINTS' when solid_support >= 0.85 then 'SOLID_CANDIDATE' when l_range >= 7 and l_range >= 1.5 * greatest(c_range, 1e-6) then 'BRIGHTNESS_SCALE_CANDIDATE'
   when c_range >= 7 and c_range >= 1.5 * greatest(l_range, 1e-6) then 'SATURATION_SCALE_CANDIDATE' else 'MIXED_SCALE_CANDIDATE' end as encoding from st"""))
def g10_family_class(spark, sf):
    m = markers(spark, sf)
    return CF.family_class(m, CF.family_medoid(m, ["filename", "family"]), ["filename", "family"])


@query(with_(f"mk as ({MARK_SRC.format(hex=hex_sql(MARK_HEX))})", "jx as (select mk.*, case family % 2 when 0 then '#C62828' else '#1F4FD8' end as expected_hex from mk)", "hx as (select distinct observed_hex, expected_hex from jx)",
             *pair_sql("hx", "observed_hex", "expected_hex", "d", "hd"), f"pt as (select jx.filename, jx.family, {r6('d')} as delta_e, round_even(d * 1000000.0, 0) as micro from jx join hd using (observed_hex, expected_hex))",
             select=f"select filename, family, count(*) as n_points, round_even(sum(micro) / count(*), 0) / 1000000.0 as point_mean, {r6('median(delta_e)')} as point_median, {r6('quantile_cont(delta_e, 0.9)')} as point_p90, max(delta_e) as point_max from pt group by 1, 2"))
def g08_scatter_point_distance(spark, sf):
    m = markers(spark, sf)
    matched = m.groupBy("filename", "family").agg(F.max(F.expr("case family % 2 when 0 then '#C62828' else '#1F4FD8' end")).alias("expected_hex"))
    return CF.point_stats(CF.point_distance(m, matched, ["filename", "family"]), ["filename", "family"])


# ------------------------------------------------------------------------------------- overlap
FAMILY_EXPRS = {
    "filename": "l_orderkey", "family": "l_linenumber",
    "r": "min((l_partkey * 7) % 256)", "g": "min((l_partkey * 13) % 256)", "b": "min((l_partkey * 29) % 256)",
    "core_support": "max(1 - l_tax)", "pixels": "cast(sum(l_quantity) as bigint)",
}
FAMILIES_SQL = "fa as (select " + ", ".join(f"{e} as {n}" for n, e in FAMILY_EXPRS.items()) + " from lineitem group by l_orderkey, l_linenumber)"
EVID_SQL = "ev as (select l_orderkey as filename, l_linenumber as target, 1 + l_partkey % 7 as base_a, 1 + l_suppkey % 7 as base_b, max(l_discount * 10) as near_both, max(l_tax * 10) as xbin from lineitem where l_linenumber <> 1 + l_partkey % 7 and l_linenumber <> 1 + l_suppkey % 7 and 1 + l_partkey % 7 < 1 + l_suppkey % 7 group by 1, 2, 3, 4)"


def families(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    aggs = [F.expr(e).alias(n) for n, e in FAMILY_EXPRS.items() if n not in ("filename", "family")]
    return g.agg(*aggs).withColumnsRenamed({"l_orderkey": "filename", "l_linenumber": "family"}).withColumn("family", F.col("family").cast("bigint"))


def triples(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("l_orderkey as filename", "cast(l_linenumber as bigint) as target", "1 + l_partkey % 7 as base_a", "1 + l_suppkey % 7 as base_b", "l_discount * 10 as near_both", "l_tax * 10 as xbin")
    e = e.where("target <> base_a and target <> base_b and base_a < base_b")
    return e.groupBy("filename", "target", "base_a", "base_b").agg(F.max("near_both").alias("near_both"), F.max("xbin").alias("xbin"))


RESIDUAL_GRID = """gr as (select i / 100.0::double as wa, j / 100.0::double as wb from range(101) t(i), range(101) u(j) where i + j <= 100)"""
_PRED = lambda c: f"pow(t{c} - (wa * a{c} + wb * b{c} + (1 - wa - wb) * 255.0::double), 2)"


@query(with_("tr as (select p_partkey, p_partkey * 7 % 256 as tr, p_partkey * 13 % 256 as tg, p_partkey * 29 % 256 as tb, p_partkey * 31 % 256 as ar, p_partkey * 37 % 256 as ag, p_partkey * 41 % 256 as ab, p_size * 5 % 256 as br, p_size * 43 % 256 as bg, p_size * 3 as bb from part)",
             RESIDUAL_GRID, select=f"select p_partkey, {r6('sqrt(min(' + ' + '.join(_PRED(c) for c in 'rgb') + '))')} as residual from tr, gr group by p_partkey"))
def g34_mixture_residual(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey * 7 % 256 as tr", "p_partkey * 13 % 256 as tg", "p_partkey * 29 % 256 as tb", "p_partkey * 31 % 256 as ar", "p_partkey * 37 % 256 as ag", "p_partkey * 41 % 256 as ab", "p_size * 5 % 256 as br", "p_size * 43 % 256 as bg", "p_size * 3 as bb")
    t, a, b = (tuple(F.col(f"{x}{c}").cast("double") for c in "rgb") for x in "tab")
    return p.select("p_partkey", rint_round(CF.mixture_residual(t, a, b)).alias("residual"))


@query(with_(
    FAMILIES_SQL, EVID_SQL, RESIDUAL_GRID,
    "nf as (select filename from fa group by filename having count(*) >= 3)",
    """jj as (select ev.*, t.r as tr, t.g as tg, t.b as tb, a.r as ar, a.g as ag, a.b as ab, b.r as br, b.g as bg, b.b as bb from ev join nf using (filename) join fa t on t.filename = ev.filename and t.family = ev.target join fa a on a.filename = ev.filename and a.family = ev.base_a join fa b on b.filename = ev.filename and b.family = ev.base_b
       where (near_both >= 0.20 or xbin >= 0.25) and a.core_support >= 0.70 and b.core_support >= 0.70 and sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) >= 45 and least(a.pixels, b.pixels) >= 0.35 * t.pixels)""",
    f"rs as (select filename, target, base_a, base_b, near_both, xbin, sqrt(min({' + '.join(_PRED(c) for c in 'rgb')})) as residual from jj, gr group by 1, 2, 3, 4, 5, 6)",
    "be as (select * from rs where residual <= 12 qualify row_number() over (partition by filename, target order by round_even((1 - least(1.0, residual / 12) + near_both + xbin) * 1e9, 0) desc, base_a, base_b) = 1)",
    select=f"select fa.filename, cast(fa.family as bigint) as family, case when be.target is null then 'BASE' else 'OVERLAP_DERIVED' end as role, base_a, base_b, {r6('residual')} as residual from fa left join be on be.filename = fa.filename and be.target = fa.family"))
def g33_overlap_derived(spark, sf):
    return CF.overlap_derived(families(spark, sf), triples(spark, sf), "filename")


XROWS = ["l_orderkey as filename", "cast(1 + l_partkey % 3 as bigint) as family", "l_suppkey % 4 as bin", "l_quantity as y"]


@query(with_(
    f"xr as (select {', '.join(XROWS)} from lineitem)", "md as (select filename, family, bin, median(y) as my from xr group by 1, 2, 3)",
    "tp as (select distinct filename, cast(v.t as bigint) as target, cast(v.a as bigint) as base_a, cast(v.b as bigint) as base_b from xr, (values (1, 2, 3), (2, 1, 3), (3, 1, 2)) v(t, a, b))",
    "jn as (select tp.*, t.my as yt, a.my as ya, b.my as yb from tp join md t on t.filename = tp.filename and t.family = tp.target left join md a on a.filename = tp.filename and a.family = tp.base_a and a.bin = t.bin left join md b on b.filename = tp.filename and b.family = tp.base_b and b.bin = t.bin)",
    select=f"select filename, target, base_a, base_b, count(*) as n_bins, {r6('avg(case when abs(ya - yb) <= 14 and yt between least(ya, yb) - 14 and greatest(ya, yb) + 14 then 1 else 0 end)')} as share from jn group by 1, 2, 3, 4"))
def g35_xbin_cooccurrence(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*XROWS)
    three = "explode(array(struct(1L as target, 2L as base_a, 3L as base_b), struct(2L as target, 1L as base_a, 3L as base_b), struct(3L as target, 1L as base_a, 2L as base_b))) as v"
    tp = rows.select("filename").distinct().selectExpr("filename", three).select("filename", "v.*")
    return CF.bin_cooccurrence(rows, tp, "filename")


_SRC = {"BAR": "l_returnflag = 'A'", "LINE": "l_returnflag = 'N'", "MARKER": "l_returnflag = 'R'"}


@query(with_(f"ob as (select l_orderkey as filename, {hex_sql('l_partkey')} as observed_hex, case l_returnflag when 'A' then 'BAR' when 'N' then 'LINE' else 'MARKER' end as representation, case when l_returnflag = 'R' and l_tax > 0.05 then 'VARIATION' else 'SOLID' end as family_type, 1 - l_discount as support, cast(l_quantity as bigint) as n_marks from lineitem)",
             select=f"select filename, count(*) as n_observed_colors, cast(sum(n_marks) as bigint) as n_marks, max(case when family_type = 'VARIATION' then 1 else 0 end) as internal_variation, {r6('avg(support)')} as support_mean, {r6('min(support)')} as support_min from ob group by filename"))
def g36_observed_color_set(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey as filename", f"{hex_of('l_partkey')} as observed_hex", "l_returnflag", "case when l_returnflag = 'R' and l_tax > 0.05D then 'VARIATION' else 'SOLID' end as family_type", "1 - l_discount as support", "cast(l_quantity as bigint) as n_marks")
    return CF.observed_counts(CF.observed_colors(*[li.where(c) for c in _SRC.values()]))
