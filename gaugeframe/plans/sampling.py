"""Audit samples and review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import sampling as P
from gaugeframe.operators.review import review_queue
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import IMAGES, UNIT, images, table, units, with_
from gaugeframe.plans.joins import USED, used_units
from gaugeframe.plans.rules import MANUALS

SEED = 20260


def full(k: int, *by: str) -> str:
    """Condition that fails the statement where a stratum has fewer than ``k`` rows."""
    return f"case when count(*) over ({'partition by ' + ', '.join(by) if by else ''}) < {k} then error('short stratum') else true end"


def h(key: str, seed: int = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', cast({key} as varchar)))"


@query(with_(*IMAGES, f"u as (select profile, condition_code, unit_id from unit qualify row_number() over (partition by profile, condition_code order by {h('unit_id')}, unit_id) <= 2 and {full(2, 'profile', 'condition_code')})",
             select=f"select u.profile, u.condition_code, u.unit_id, i.filename from u join image i using (unit_id) qualify row_number() over (partition by u.unit_id order by {h('i.filename', SEED + 1)}, i.filename) = 1"))
def e01_stratified_unit_sample(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey as unit_id", "o_orderkey as filename")
    return P.unit_sample(units(spark, sf), o, ["profile", "condition_code"], "unit_id", "filename", 2, SEED)


@query(with_(*IMAGES, USED, f"u as (select profile, unit_id from unit where unit_id not in (select unit_id from used) qualify row_number() over (partition by profile order by {h('unit_id')}, unit_id) <= 3 and {full(3, 'profile')})",
             select=f"select u.profile, u.unit_id, i.filename from u join image i using (unit_id) qualify row_number() over (partition by u.unit_id order by {h('i.filename', SEED + 1)}, i.filename) = 1"))
def e02_stratified_profile_sample(spark, sf):
    calibration, holdout = used_units(spark, sf)
    fresh = units(spark, sf).join(calibration.union(holdout), "unit_id", "left_anti")
    o = table(spark, sf, "orders").selectExpr("o_custkey as unit_id", "o_orderkey as filename")
    return P.unit_sample(fresh, o, ["profile"], "unit_id", "filename", 3, SEED)


@query(f"""with w as (select conv_id from conversations group by conv_id having count(*) = 4 and count(distinct turn) = 4 and min(turn) = 0 and max(turn) = 3),
  s as (select conv_id from w qualify row_number() over (order by {h('conv_id')}, conv_id) <= 5 and {full(5)}) select conv_id, turn, role from conversations where conv_id in (select conv_id from s)""")
def e03_whole_unit_sample(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    chosen = P.whole_unit_sample(c, "conv_id", "turn", 0, 4, 5, SEED)
    return c.join(chosen, "conv_id", "left_semi")


@query(with_(*IMAGES, select=f"select profile, filename from image qualify row_number() over (partition by profile order by {h('filename')}, filename) <= 5 and {full(5, 'profile')}"))
def e04_row_sample_per_profile(spark, sf):
    return P.stratified(images(spark, sf).select("profile", "filename"), ["profile"], [P.draw(SEED, "filename")], 5)


@query(with_(*IMAGES, f"s as (select profile, filename from image where mark_present = 1 qualify row_number() over (partition by profile order by {h('filename')}, filename) <= 20 and {full(20, 'profile')})",
             select=f"select profile, filename, 'CASE_' || repeat('0', greatest(0, 3 - length(cast(n as varchar)))) || cast(n as varchar) as case_id from (select *, row_number() over (order by {h('filename', SEED + 1)}, filename) as n from s)"))
def e05_blind_control_sample(spark, sf):
    ok = images(spark, sf).where("mark_present = 1").select("profile", "filename")
    return P.blind_cases(ok, "profile", "filename", 20, SEED)


_OK = "case when o_orderpriority = '5-LOW' then null when o_totalprice > 400000 then 1 else 0 end"


@query(f"""with d as (select o_orderstatus as profile, o_orderkey as filename, {_OK} as canvas_ok, o_totalprice < 5000 as stress from orders),
  r as (select *, row_number() over (partition by profile, canvas_ok order by {h('filename')}, filename) as rk from d where canvas_ok is not null),
  ch as (select profile, filename from r where rk <= case when canvas_ok = 1 then 10 else 11 end),
  hv as (select profile, count(*) as have from ch group by 1),
  ex as (select d.profile, filename, row_number() over (partition by d.profile order by {h('filename', SEED + 1)}, filename) as rk from d where filename not in (select filename from ch)),
  k as (select filename from ch union select filename from ex left join hv using (profile) where rk <= 21 - coalesce(have, 0) union select filename from d where stress)
  select profile, filename, canvas_ok, case when stress then 1 else 0 end as is_stress from d where filename in (select filename from k)""")
def e06_split_quota_sample(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderstatus as profile", "o_orderkey as filename", f"{_OK} as canvas_ok", "o_totalprice < 5000 as stress")
    out = P.quota_sample(d, "profile", "filename", "canvas_ok", F.col("stress"), 21, SEED)
    return out.select("profile", "filename", "canvas_ok", "is_stress")


@query(with_(*IMAGES, "v as (select profile, filename, presence_confidence as conf, case when y_eval = 1 then ydisp end as spread from image)",
             "lo as (select profile, filename from v qualify row_number() over (partition by profile order by conf, filename) <= 3)",
             "hi as (select profile, filename from v where spread is not null qualify row_number() over (partition by profile order by spread desc, filename) <= 3)",
             "rk as (select profile, filename, 'LOW_CONFIDENCE' as reason from lo union all select profile, filename, 'HIGH_SPREAD' from hi where filename not in (select filename from lo))",
             select=f"select * from rk union all (select profile, filename, 'RANDOM_STRATIFIED' from v where filename not in (select filename from rk) qualify row_number() over (partition by profile order by {h('filename')}, filename) <= 2)"))
def e07_risk_audit_selection(spark, sf):
    v = images(spark, sf).selectExpr("profile", "filename", "presence_confidence as conf", "case when y_eval = 1 then ydisp end as spread")
    return P.risk_selection(v, "profile", "filename", "conf", "spread", 3, 3, 2, SEED)


_EXP = "case o_orderkey % 3 when 0 then 'BAR' when 1 then 'LINE' else 'SCATTER' end"


@query(f"""select o_orderkey as filename, {_EXP} as expected, {MANUALS.exprs['observed']} as observed, cast(null as varchar) as manual_visible_type, cast(null as varchar) as manual_notes
  from orders where {_EXP} <> {MANUALS.exprs['observed']} and not (o_orderstatus = 'P' and o_orderpriority = '1-URGENT')""")
def e08_discrepancy_queue(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey as filename", f"{_EXP} as expected", f"{MANUALS.exprs['observed']} as observed", "o_orderstatus = 'P' and o_orderpriority = '1-URGENT' as conflict")
    cond = (F.col("expected") != F.col("observed")) & ~F.col("conflict")
    return review_queue(o, cond, ["filename", "expected", "observed"], ["manual_visible_type", "manual_notes"], "filename")


@query("""with d as (select o_orderpriority as profile, o_orderkey as filename, o_totalprice > 499500 as good from orders), n as (select profile, count(*) filter (where good) as k from d group by 1)
  select profile, filename from d join n using (profile) where good or k < 2 qualify row_number() over (partition by profile order by filename) <= 2""")
def e09_first_k_per_profile(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderpriority as profile", "o_orderkey as filename", "o_totalprice > 499500 as good")
    return P.first_preferred(d, "profile", "filename", F.col("good"), 2)


@query("""with l as (select user_id, arg_max(event_type, event_id) as last_type, max(event_id) as last_id from events group by user_id),
  b as (select user_id, event_id as best_id, value as best_value from events qualify row_number() over (partition by user_id order by value desc, event_id desc) = 1) select * from l join b using (user_id)""")
def e10_dedupe_keep(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    last = P.best_per_key(e, ["user_id"], F.col("event_id")).selectExpr("user_id", "event_type as last_type", "event_id as last_id")
    best = P.best_per_key(e, ["user_id"], F.struct("value", "event_id")).selectExpr("user_id", "event_id as best_id", "value as best_value")
    return last.join(best, "user_id")


@query("""with g as (select l_suppkey, l_partkey, sum(l_quantity) as weight, count(*) as votes, max(l_discount) as conf from lineitem group by all)
  select l_suppkey, l_partkey, weight, votes, conf from g qualify row_number() over (partition by l_suppkey order by weight desc, votes desc, conf desc, l_partkey) = 1""")
def e11_argbest_with_ties(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"), F.count(F.lit(1)).alias("votes"), F.max("l_discount").alias("conf"))
    return P.best_per_key(g, ["l_suppkey"], F.struct("weight", "votes", "conf", (-F.col("l_partkey")).alias("first")))


@query(with_(*IMAGES, f"d as (select profile, filename, case when height >= 0.1 then 1 else 0 end as canvas_ok from image where filename not in (select event_id from events where event_type = 'click'))",
             select=f"select profile, canvas_ok, filename from d qualify row_number() over (partition by profile, canvas_ok order by {h('filename')}, filename) <= 4 and {full(4, 'profile', 'canvas_ok')}"))
def e24_canvas_stratified_sample(spark, sf):
    calibration = table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("filename"))
    fresh = images(spark, sf).selectExpr("profile", "filename", "cast(height >= 0.1D as int) as canvas_ok").join(calibration, "filename", "left_anti")
    return P.stratified(fresh, ["profile", "canvas_ok"], [P.draw(SEED, "filename")], 4).select("profile", "canvas_ok", "filename")
