"""Runs, islands, covers and groups of positions inside an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions.numbers import percentile, rint_round
from gaugeframe.functions.text import letters_in, upper_label
from gaugeframe.operators import ordered as O
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import Derived, r6, table, with_


@query("""select conv_id, turn, role from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role) as p from conversations) where p is distinct from role""")
def e12_consecutive_dedupe(spark, sf):
    return O.consecutive_distinct(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("""select conv_id, n_values, case when n_values >= 2 then case when bad then 0 else 1 end end as monotone from (
  select conv_id, count(*) as n_values, coalesce(bool_or(v < p), false) as bad from (select conv_id, v, lag(v) over (partition by conv_id order by turn, v) as p from (select conv_id, turn, length(text) as v from conversations)) group by conv_id)""")
def e13_monotonic_flag(spark, sf):
    c = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "length(text) as v")
    return O.monotone(c, "conv_id", "turn", "v")


@query("select conv_id, string_agg(text, ' ' order by turn, role, text) as text from conversations group by conv_id")
def e14_ordered_concat(spark, sf):
    return O.ordered_concat(table(spark, sf, "conversations"), "conv_id", ["turn", "role"], "text")


HUES = Derived("mk", "lineitem", {"filename": "l_orderkey", "hue": "cast((l_partkey * 37) % 360 as double)", "pixels": "l_quantity"})


@query(with_(HUES.cte,
             "g as (select *, hue - lag(hue) over (partition by filename order by hue, pixels) as gap from mk)",
             "i as (select *, sum(case when gap > 25 then 1 else 0 end) over (partition by filename order by hue, pixels rows unbounded preceding) as isl from g)",
             "w as (select *, max(isl) over (partition by filename) as last, min(hue) over (partition by filename) + 360 - max(hue) over (partition by filename) <= 25 as wraps from i)",
             "f as (select filename, case when wraps and isl = last then 0 else isl end as fam, count(*) as n_markers, sum(greatest(pixels, 1) * sin(radians(hue))) as sy, sum(greatest(pixels, 1) * cos(radians(hue))) as cx from w group by 1, 2)",
             "h as (select filename, n_markers, round_even(((degrees(atan2(sy, cx)) + 360.0) - 360.0 * floor((degrees(atan2(sy, cx)) + 360.0) / 360.0)) * 10000.0, 0) / 10000.0 as family_hue from f)",
             select="select *, row_number() over (partition by filename order by family_hue, n_markers) as family_rank from h"))
def e15_circular_islands(spark, sf):
    return O.hue_families(HUES.spark(spark, sf), "filename", "hue", "pixels")


LANES = Derived("b", "lineitem", {"filename": "l_orderkey", "bin": "l_partkey % 40"})


@query(with_(LANES.cte, "d as (select distinct filename, bin from b)", "g as (select *, bin - lag(bin) over (partition by filename order by bin) as gap from d)",
             "i as (select *, sum(case when gap > 2 then 1 else 0 end) over (partition by filename order by bin) as isl from g)",
             "p as (select filename, isl, min(bin) as a, max(bin) as z, count(*) as n from i group by 1, 2)",
             "c as (select *, (a * 20 + least(789, (z + 1) * 20 - 1)) / 2 as center from p)",
             select=f"select filename, count(*) as n_groups, {r6('(max(center) - min(center)) / 789')} as span, cast(sum(n) as bigint) as occupied_bins, {r6('(max(z) - min(a) + 1) / 40')} as extent, {r6('sum(n) / 40')} as occupied_ratio from c group by filename"))
def e16_lane_groups(spark, sf):
    return O.lane_groups(LANES.spark(spark, sf), "filename", "bin", 40, 20, 790)


SEGMENTS = Derived("s", "lineitem", {"filename": "l_orderkey", "b1": "l_partkey % 40", "b2": "least(39, l_partkey % 40 + l_linenumber)", "x1": "l_partkey % 1000", "x2": "l_partkey % 1000 + cast(l_quantity as bigint) * 4"})


@query(with_(SEGMENTS.cte, select=f"select filename, {r6('count(distinct bin) / 40')} as support from (select filename, unnest(range(b1, b2 + 1)) as bin from s) group by filename"))
def e17_bin_union_support(spark, sf):
    return O.bin_union_support(SEGMENTS.spark(spark, sf), "filename", "b1", "b2", 40)


CENTERS = Derived("c", "lineitem", {"filename": "l_orderkey", "pos": "cast(l_partkey % 1200 as double)", "w": "l_quantity", "src": "l_returnflag", "h": "cast(8 + l_linenumber * 3 as double)"})


@query(with_(CENTERS.cte,
             "o as (select *, row_number() over (partition by filename order by pos) as rn, count(*) over (partition by filename) as n, pos - lag(pos) over (partition by filename order by pos) as gap from c)",
             "s as (select *, min(gap) filter (where gap > 1) over (partition by filename) as lo, max(gap) filter (where gap > 1) over (partition by filename) as hi from o)",
             "t as (select *, n > 2 and hi / greatest(1, lo) >= 2.2 as two, n > 2 and lo is null as flat from s)",
             "i as (select *, sum(case when flat or (coalesce(two, false) and gap <= sqrt(lo * hi)) then 0 else 1 end) over (partition by filename order by rn) - case when flat then 0 else 0 end as isl from t)",
             select=f"select filename, {r6('avg(pos)')} as center, count(*) as n_members from i group by filename, isl"))
def e18_gap_scale_groups(spark, sf):
    g = O.gap_scale_groups(CENTERS.spark(spark, sf), "filename", "pos")
    return g.withColumn("center", rint_round(F.col("center")))


def fold_sql(tol: str, weight: str, extra: str = "") -> tuple[str, ...]:
    """Recursive twin of the running-centre scan, one row at a time."""
    return (
        f"it as (select filename, pos as p, cast(sum({weight}) as double) as w, count(*) as m, list(distinct src) as labels, row_number() over (partition by filename order by pos) as rn from c group by filename, pos)",
        f"tl as (select filename, max(pos) - min(pos) as span{extra} from c group by filename)",
        f"jt as (select it.*, {tol} as tol from it join tl using (filename))",
        """fold as (select filename, rn, cast(0 as bigint) as grp, p * w as wx, w as ws from jt where rn = 1
           union all select j.filename, j.rn, case when abs(j.p - f.wx / f.ws) <= j.tol then f.grp else f.grp + 1 end,
             case when abs(j.p - f.wx / f.ws) <= j.tol then f.wx + j.p * j.w else j.p * j.w end, case when abs(j.p - f.wx / f.ws) <= j.tol then f.ws + j.w else j.w end
           from fold f join jt j on j.filename = f.filename and j.rn = f.rn + 1)""",
        "gr as (select jt.*, fold.grp from jt join fold using (filename, rn))",
    )


@query("with recursive " + ",\n".join([CENTERS.cte, *fold_sql("greatest(10.0::double, 0.035::double * span)", "w")]) + f""" select filename, grp as "group", {r6('sum(p * w) / sum(w)')} as center, cast(sum(w) as double) as strength, cast(sum(m) as bigint) as n_members,
   (select string_agg(l, '+' order by l) from (select distinct unnest(flatten(list(labels))) as l)) as sources from gr group by filename, grp""")
def e19_anchor_merge(spark, sf):
    tol = F.greatest(F.lit(10.0), 0.035 * F.col("span"))
    g = O.running_center_groups(CENTERS.spark(spark, sf), "filename", "pos", F.col("w"), tol, label="src")
    return g.withColumn("center", rint_round(F.col("center")))


@query(with_(SEGMENTS.cte, "d as (select *, max(x2) over (partition by filename order by x1, x2 rows between unbounded preceding and 1 preceding) as seen from s)",
             "i as (select *, sum(case when x1 > seen + 1 then 1 else 0 end) over (partition by filename order by x1, x2 rows unbounded preceding) as isl from d)",
             "p as (select filename, isl, min(x1) as a, max(x2) as b, count(*) as n from i group by 1, 2)",
             select=f"select filename, cast(sum(n) as bigint) as n_segments, count(*) as n_islands, min(a) as first, max(b) as last, cast(sum(b - a + 1) as bigint) as covered, {r6('sum(b - a + 1) / 1200')} as coverage, case when {r6('sum(b - a + 1) / 1200')} >= 0.25 then 1 else 0 end as kept from p group by filename"))
def e20_interval_union(spark, sf):
    u = O.interval_union(SEGMENTS.spark(spark, sf), "filename", "x1", "x2", 1200.0)
    return u.withColumn("kept", (F.col("coverage") >= 0.25).cast("int"))


@query("with recursive " + ",\n".join([CENTERS.cte, *fold_sql("greatest(3.0::double, 0.5::double * med)", "1", ", median(h) as med")]) + f""" select filename, grp as "group", {r6('sum(p * w) / sum(w)')} as center, cast(sum(m) as bigint) as n_members from gr group by filename, grp""")
def e21_token_lines(spark, sf):
    tol = F.greatest(F.lit(3.0), 0.5 * F.col("med"))
    stats = [percentile(F.col("h"), 0.5).alias("med")]
    g = O.running_center_groups(CENTERS.spark(spark, sf), "filename", "pos", F.lit(1), tol, stats=stats)
    return g.select("filename", "group", rint_round(F.col("center")).alias("center"), "n_members")


WORDS = Derived("w", "lineitem", {
    "filename": "l_orderkey", "x1": "cast(l_partkey % 300 as double)", "x2": "cast(l_partkey % 300 as double) + l_quantity",
    "y1": "cast(10 as double)", "y2": "cast(18 + l_linenumber as double)", "h": "cast(8 + l_linenumber as double)", "conf": "l_discount * 1000", "text": "concat(l_returnflag, l_linestatus, cast(l_suppkey as string))",
})


@query(with_(WORDS.cte, "d as (select *, greatest(0.0::double, x1 - lag(x2) over (partition by filename order by x1, x2, text)) as gap from w)",
             "q as (select filename, quantile_cont(gap, 0.35) filter (where gap > 0.5) as small, median(h) as typical from d group by filename)",
             "l as (select filename, case when small is not null then greatest(10, least(34, greatest(2.5 * small, 1.45 * typical))) else greatest(11, 1.45 * typical) end as lim from q)",
             "p as (select d.*, sum(case when gap > lim then 1 else 0 end) over (partition by filename order by x1, x2, text rows unbounded preceding) as phrase from d join l using (filename))",
             f"g as (select filename, cast(phrase as bigint) as phrase, string_agg(text, ' ' order by x1, x2, text) as text, min(x1) as x1, max(x2) as x2, min(y1) as y1, max(y2) as y2, {r6('sum(conf * greatest(1, x2 - x1)) / sum(greatest(1, x2 - x1))')} as confidence from p group by 1, 2)",
             select="select * from g where length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 2"))
def e22_line_phrases(spark, sf):
    p = O.line_phrases(WORDS.spark(spark, sf), ["filename"])
    return p.where(letters_in(upper_label(F.col("text"))) >= 2)


CANDS = Derived("k", "lineitem", {"filename": "l_orderkey", "score": "l_extendedprice", "coord": "l_partkey * 1000 + l_suppkey"})


@query(with_(CANDS.cte, "b as (select *, max(score) over (partition by filename) as best from k)",
             "x as (select filename, coord as x_coord from b where score >= 0.85 * best qualify row_number() over (partition by filename order by score desc, coord desc) = 1)",
             "y as (select filename, coord as y_coord from b where score >= 0.88 * best qualify row_number() over (partition by filename order by abs(coord - 100000), score desc, coord) = 1)",
             select="select filename, x_coord, y_coord from x join y using (filename)"))
def e23_near_best_choice(spark, sf):
    k = CANDS.spark(spark, sf)
    x = O.near_best(k, "filename", "score", 0.85, [-F.col("score"), -F.col("coord")]).select("filename", F.col("coord").alias("x_coord"))
    y = O.near_best(k, "filename", "score", 0.88, [F.abs(F.col("coord") - 100000), -F.col("score")]).select("filename", F.col("coord").alias("y_coord"))
    return x.join(y, "filename")
