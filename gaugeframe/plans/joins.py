"""Integration, lookups, coverage and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import status as S
from gaugeframe.functions.text import pad_condition
from gaugeframe.operators import integrate as I
from gaugeframe.operators.pairs import pair_gaps
from gaugeframe.operators.review import overlay
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import IMAGES, UNIT, Derived, image_facts, r6, table, units, with_
from gaugeframe.plans.rules import AXES, COLOR_ROWS, MARK_SQL, MARKS, fa, tr

REVIEW = Derived("v", "events", {
    "filename": "event_id",
    "mx": "case event_type when 'click' then 'sim' when 'view' then 'nao' else '' end",
    "my": "case when value > 20 then 'Y' else 'N' end",
    "mc": "case event_type when 'error' then 'UNEVALUABLE' else 'BOTH_PRESENT' end",
})
TICKS = Derived("t", "orders", {"filename": "o_orderkey", "needs": "case when o_orderstatus = 'P' then '1' else '0' end", "both_auto": "case when o_orderkey % 7 <> 0 then 'true' else 'false' end"})
PLOTS = Derived("g", "orders", {"filename": "o_orderkey", "layout_error": "cast(o_orderkey * 7 % 100 as double) / 1000"})
AXIS_SQL = f"""case when upper(trim(coalesce(raw,''))) = 'BOTH_PRESENT' then 'CONFORMING' when upper(trim(coalesce(raw,''))) in ('UNEVALUABLE','NOT_EVALUABLE') then 'UNEVALUABLE'
  when {tr('xe')} and {tr('ye')} then case when {tr('xp')} and {tr('yp')} then 'CONFORMING' else 'NONCONFORMING' end
  when trim(coalesce(raw,'')) <> '' then 'NONCONFORMING' else 'UNEVALUABLE' end"""
COLOR_SQL = f"""case when {tr('no_mark')} or not ({tr('evaluable')}) then 'UNEVALUABLE' when {tr('strict')} or upper(trim(coalesce(raw,''))) = 'MATCH' then 'CONFORMING' else 'NONCONFORMING' end"""
MAN_SQL = f"""case when mx is null and my is null and mc is null then null when {tr('mx')} and {tr('my')} then 'CONFORMING' when ({tr('mx')} or {fa('mx')}) and ({tr('my')} or {fa('my')}) then 'NONCONFORMING'
  when upper(trim(coalesce(mc,''))) in ('BOTH_PRESENT','CONFORMING','OK','PRESENT') then 'CONFORMING' when upper(trim(coalesce(mc,''))) in ('X_ONLY','Y_ONLY','NONE','ABSENT','NONCONFORMING') then 'NONCONFORMING'
  when upper(trim(coalesce(mc,''))) in ('UNEVALUABLE','NOT_EVALUABLE') then 'UNEVALUABLE' end"""
INTEGRATED = (
    MARKS.cte, AXES.cte, COLOR_ROWS.cte, TICKS.cte, PLOTS.cte, REVIEW.cte,
    f"ms as (select filename, {MARK_SQL} as mark_status from m)", f"as_ as (select filename, {AXIS_SQL} as axis_status from a)",
    f"cs as (select filename, {COLOR_SQL} as color_status from c)", f"rs as (select filename, {MAN_SQL} as manual from v)",
    f"""integrated as (select ms.filename, mark_status, axis_status, color_status, layout_error,
      case when {tr('needs')} then coalesce(manual, 'PENDING_FINAL_ADJUDICATION') when {tr('both_auto')} then 'CONFORMING' else coalesce(manual, 'PENDING_FINAL_ADJUDICATION') end as tick_status,
      case when {tr('needs')} then case when manual is not null then 'MANUAL_REVIEW' else 'REVIEW_REQUIRED' end when {tr('both_auto')} then 'AUTO_FROZEN'
           when manual is not null then 'MANUAL_REVIEW' else 'AUTO_EXCEPTION' end as tick_source
      from ms join as_ using (filename) join cs using (filename) join t using (filename) join g using (filename) left join rs using (filename))""",
)


def integrated(spark, sf):
    mark = MARKS.spark(spark, sf).select("filename", S.mark_status(F.col("raw"), F.col("present"), F.col("absent")).alias("mark_status"))
    axis = AXES.spark(spark, sf).select("filename", S.axis_status(*[F.col(c) for c in ("raw", "xe", "ye", "xp", "yp")]).alias("axis_status"))
    color = COLOR_ROWS.spark(spark, sf).select("filename", S.color_dimension_status(*[F.col(c) for c in ("raw", "evaluable", "no_mark", "strict")]).alias("color_status"))
    review = REVIEW.spark(spark, sf).select("filename", S.manual_presence(F.col("mx"), F.col("my"), F.col("mc")).alias("manual"))
    sources = {"axis": axis, "color": color, "ticks": TICKS.spark(spark, sf), "plot": PLOTS.spark(spark, sf)}
    j = I.integrate(mark, sources, review, "filename")
    j = j.withColumn("d", S.presence_decision(F.col("needs"), F.col("both_auto"), F.col("manual")))
    return j.select("filename", "mark_status", "axis_status", "color_status", "layout_error", F.col("d.status").alias("tick_status"), F.col("d.source").alias("tick_source"))


@query(with_(*INTEGRATED, select="select * from integrated"))
def c01_integrate_sources(spark, sf):
    return integrated(spark, sf)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def c02_assert_unique_key(spark, sf):
    return I.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("""select 'lines' as source, o_orderkey as filename from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
  union all select 'review', o_orderkey from orders where not exists (select 1 from events where event_id = o_orderkey)""")
def c03_assert_coverage(spark, sf):
    universe = table(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filename"))
    return I.missing_from(universe, {"lines": lines, "review": REVIEW.spark(spark, sf)}, "filename")


@query(with_(*IMAGES, select="select filename, unit_id, profile, condition_code, participant_id from image"))
def c04_attach_metadata(spark, sf):
    out = I.attach(image_facts(spark, sf), units(spark, sf), "unit_id", ["profile", "condition_code", "participant_id", "association_method"])
    return out.select("filename", "unit_id", "profile", "condition_code", "participant_id")


@query("""select o_orderkey as filename, o_custkey as unit_id, c_nationkey as participant_id, lpad(regexp_replace(cast(c_nationkey % 4 as varchar) || '.0', '\\.0$', ''), 2, '0') as condition_code
  from orders left join customer on o_custkey = c_custkey""")
def c05_attach_crosswalk(spark, sf):
    dim = table(spark, sf, "customer").withColumn("code", F.concat((F.col("c_nationkey") % 4).cast("string"), F.lit(".0")))
    cw = I.crosswalk(dim, {"unit_id": ["unit_id", "c_custkey"], "participant_id": ["participant", "c_nationkey"], "condition_code": ["condition", "code"], "examples": ["with_examples"]})
    out = I.attach(image_facts(spark, sf), cw, "unit_id", ["participant_id", "condition_code"])
    return out.select("filename", "unit_id", "participant_id", "condition_code")


@query("""select o_orderkey as filename, sha256(c_name) as prompt_sha256, c_name || '.txt' as prompt_file from orders left join customer on o_custkey = c_custkey""")
def c06_attach_prompt_manifest(spark, sf):
    manifest = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.sha2("c_name", 256).alias("prompt_sha256"), F.concat("c_name", F.lit(".txt")).alias("prompt_file"))
    return I.attach(image_facts(spark, sf), manifest, "unit_id", ["prompt_sha256", "prompt_file"]).select("filename", "prompt_sha256", "prompt_file")


@query("""with l as (select l_orderkey as filename, case when l_returnflag = 'A' then 'X' else 'Y' end as axis, count(*) as n_tokens, max(l_quantity) as max_value from lineitem group by all),
  b as (select o_orderkey as filename, unnest(['X','Y']) as axis from orders)
  select b.filename, b.axis, coalesce(n_tokens, 0) as n_tokens, max_value from b left join l on l.filename = b.filename and l.axis = b.axis""")
def c07_axis_lookup_join(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey as filename", "case when l_returnflag = 'A' then 'X' else 'Y' end as axis", "l_quantity")
    lookup = li.groupBy("filename", "axis").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("l_quantity").alias("max_value"))
    base = table(spark, sf, "orders").selectExpr("o_orderkey as filename", "explode(array('X', 'Y')) as axis")
    return I.attach(base, lookup, ["filename", "axis"], ["n_tokens", "max_value"]).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("bigint")))


SPEC = """spec as (select unit_id, axis, scope from (
   select c_custkey as unit_id, 'X' as axis, case when c_nationkey % 3 = 0 then 'EXAMPLES_ONLY' else 'EXHAUSTIVE' end as scope from customer where c_acctbal > 0
   union all select c_custkey, 'Y', case when c_nationkey % 5 = 0 then 'NOT_SPECIFIED' else 'EXHAUSTIVE' end from customer where c_acctbal > 0))"""


def spec_long(spark, sf):
    from gaugeframe.sources.spec import spec_axes

    wide = table(spark, sf, "customer").where("c_acctbal > 0").selectExpr(
        "c_custkey as unit_id",
        "case when c_nationkey % 3 = 0 then 'EXAMPLES_ONLY' else 'EXHAUSTIVE' end as x_scope",
        "case when c_nationkey % 5 = 0 then 'NOT_SPECIFIED' else 'EXHAUSTIVE' end as y_scope",
    )
    return spec_axes(wide, ["unit_id"], ["scope"])


@query(with_(SPEC, select="select o_orderkey as filename, s.axis, s.scope from (select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 'Y' else 'X' end as axis from orders) o join spec s on s.unit_id = o.o_custkey and s.axis = o.axis"))
def c08_spec_join(spark, sf):
    obs = table(spark, sf, "orders").selectExpr("o_orderkey as filename", "o_custkey as unit_id", "case when o_orderkey % 3 = 0 then 'Y' else 'X' end as axis")
    return obs.join(spec_long(spark, sf), ["unit_id", "axis"]).select("filename", "axis", "scope")


@query("""select e.vec_id, e.label, r.ref_id from embeddings e join (select label, min(vec_id) as ref_id from embeddings group by label) r using (label) where e.vec_id <> r.ref_id""")
def c09_reference_broadcast(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    ref = e.groupBy("label").agg(F.min("vec_id").alias("ref_id"))
    return e.join(ref, "label").where("vec_id <> ref_id")


USED = "used as (select distinct o_custkey as unit_id from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000 union select o_custkey from orders where o_orderstatus = 'P' and o_totalprice < 50000)"


def used_units(spark, sf):
    o = table(spark, sf, "orders")
    calibration = o.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_custkey").alias("unit_id"))
    holdout = o.where("o_orderstatus = 'P' and o_totalprice < 50000").select(F.col("o_custkey").alias("unit_id"))
    return calibration, holdout


@query(with_(UNIT, USED, select="select unit_id, profile from unit where unit_id not in (select unit_id from used)"))
def c10_exclude_used_units(spark, sf):
    calibration, holdout = used_units(spark, sf)
    u = units(spark, sf)
    return u.join(calibration, "unit_id", "left_anti").join(holdout, "unit_id", "left_anti").select("unit_id", "profile")


@query("""select o_orderkey as filename, o_custkey as unit_id from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING')""")
def c11_semi_select_units(spark, sf):
    chosen = table(spark, sf, "customer").where("c_acctbal > 5000 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("unit_id"))
    return image_facts(spark, sf).select("filename", "unit_id").join(chosen, "unit_id", "left_semi")


@query("""select o_orderkey as filename, coalesce(m.manual, a.auto) as final_status, case when m.manual is not null then 'MANUAL' else 'AUTO' end as decision_source
  from (select o_orderkey, case when o_orderstatus = 'F' then 'NONCONFORMING' else 'CONFORMING' end as auto from orders) a
  left join (select event_id, case event_type when 'click' then 'CONFORMING' when 'error' then 'UNEVALUABLE' when 'view' then 'NONCONFORMING' end as manual from events) m on event_id = o_orderkey""")
def c12_adjudication_overlay(spark, sf):
    auto = table(spark, sf, "orders").selectExpr("o_orderkey as filename", "case when o_orderstatus = 'F' then 'NONCONFORMING' else 'CONFORMING' end as auto")
    manual = table(spark, sf, "events").selectExpr("event_id as filename", "case event_type when 'click' then 'CONFORMING' when 'error' then 'UNEVALUABLE' when 'view' then 'NONCONFORMING' end as manual")
    return overlay(auto, manual, "filename", "auto", "manual").select("filename", "final_status", "decision_source")


@query(f"""with p as (select l_orderkey, l_partkey % 1200 + 0.0::double as pos, row_number() over () as id from lineitem),
  q as (select a.l_orderkey, abs(a.pos - b.pos) as gap from p a join p b on a.l_orderkey = b.l_orderkey and a.id < b.id)
  select k.l_orderkey, count(gap) as n_pairs, min(gap) as min_gap, max(gap) as max_gap, {r6('avg(gap)')} as mean_gap from (select distinct l_orderkey from p) k left join q using (l_orderkey) group by k.l_orderkey""")
def c13_cross_candidate_pairs(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("l_orderkey", "cast(l_partkey % 1200 as double) as pos")
    return pair_gaps(p, "l_orderkey", "pos")
