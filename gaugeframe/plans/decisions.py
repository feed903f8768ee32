"""Group decisions: presence, votes, consensus, layout and the overall verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import status as S
from gaugeframe.functions.numbers import rint_round
from gaugeframe.operators import consensus as K
from gaugeframe.operators import geometry as G
from gaugeframe.operators import integrate as I
from gaugeframe.operators import ordered as O
from gaugeframe.operators import rates as R
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import UNIT, Derived, image_facts, r6, table, units, with_
from gaugeframe.plans.joins import INTEGRATED, integrated
from gaugeframe.plans.rates import VALID, validated
from gaugeframe.plans.ticks import BB, bb_results

RW, RH = 1000.0, 700.0
AREA = RW * RH
# every image is judged, also those without a candidate
EVERY = "every as (select o_orderkey as filename from orders)"


def every(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"))


RECTS = Derived("rc", "lineitem", {"filename": "l_orderkey", "h": "l_quantity * 2", "area": "l_quantity * l_linenumber * 12", "cx": "cast(l_partkey % 1000 as double)", "cy": "cast(l_suppkey * 7 % 700 as double)", "span": "l_quantity / 120", "b1": "l_partkey % 40", "b2": "least(39, l_partkey % 40 + l_linenumber)"})


@query(with_(RECTS.cte, EVERY, f"g as (select filename, count(*) as n, sum(area) as area, max(h / {RH}::double) as tall from rc group by filename)",
             f"p as (select *, n >= 2 or (n = 1 and area >= {0.0015 * AREA} and tall >= 0.055) as ok from g)",
             select=f"""select every.filename, case when ok then 1 else 0 end as present, {r6(f"case when n is null then 0.0::double when ok then least(1.0::double, 0.35::double + 0.17::double * least(n, 4) + 0.30::double * least(1.0::double, area / {0.020 * AREA}::double) + 0.18::double * least(1.0::double, tall / 0.25::double)) else 0.20::double end")} as confidence, coalesce(n, 0) as n_candidates, {r6('coalesce(tall, 0.0)')} as max_h_frac from every left join p on p.filename = every.filename"""))
def g11_bar_presence(spark, sf):
    return G.bar_presence(RECTS.spark(spark, sf).select("filename", "h", "area"), "filename", RH, AREA, every(spark, sf))


@query(with_(RECTS.cte, EVERY, "b as (select filename, count(distinct bin) / 40 as support from (select filename, unnest(range(b1, b2 + 1)) as bin from rc) group by filename)",
             "s as (select filename, max(span) as span from rc group by filename)",
             f"e as (select filename, {r6('coalesce(span, 0.0)')} as span, {r6('coalesce(support, 0.0)')} as support from every left join s using (filename) left join b using (filename))",
             select=f"""select filename, span, support, case when span >= 0.24 or support >= 0.20 then 1 else 0 end as present,
   {r6("case when span >= 0.24 or support >= 0.20 then least(1.0::double, 0.25::double + 0.80::double * least(1.0::double, span) + 0.55::double * least(1.0::double, support / 0.50::double)) else 0.15::double end")} as confidence from e"""))
def g12_line_presence(spark, sf):
    r = RECTS.spark(spark, sf)
    span = r.groupBy("filename").agg(rint_round(F.max("span")).alias("span"))
    e = G.with_absent(span.join(O.bin_union_support(r, "filename", "b1", "b2", 40), "filename"), every(spark, sf), "filename", {"span": 0.0, "support": 0.0})
    return G.line_presence(e, "span", "support")


@query(with_(RECTS.cte, EVERY, f"g as (select filename, count(*) as n, case when count(*) >= 2 then (max(cx) - min(cx)) / {RW} else 0 end as xd, case when count(*) >= 2 then (max(cy) - min(cy)) / {RH} else 0 end as yd from rc group by filename)",
             "p as (select *, n >= 2 and (xd >= 0.03 or yd >= 0.03) as ok from g)",
             select=f"""select every.filename, case when ok then 1 else 0 end as present, {r6("case when ok then least(1.0::double, 0.25::double + 0.12::double * least(n, 5) + 0.40::double * least(1.0::double, xd + yd)) when n = 1 then 0.30::double else 0.10::double end")} as confidence,
   coalesce(n, 0) as n_markers, {r6('coalesce(xd, 0.0)')} as x_dispersion, {r6('coalesce(yd, 0.0)')} as y_dispersion from every left join p on p.filename = every.filename"""))
def g13_scatter_presence(spark, sf):
    return G.scatter_presence(RECTS.spark(spark, sf).select("filename", "cx", "cy"), "filename", RW, RH, every(spark, sf))


# ------------------------------------------------------------------------------------- axis values
AXIS_CANDS = Derived("ac", "lineitem", {
    "filename": "l_orderkey", "position": "l_linenumber",
    "value": "case when l_tax = 0 then null when l_returnflag = 'R' then cast(l_linenumber * 10 + l_suppkey % 6 as double) else cast(l_linenumber * 10 as double) end",
    "score": "l_quantity", "confidence": "l_discount * 900", "part": "l_partkey",
})
_RANKED = "rk as (select *, row_number() over (partition by filename, position, value is null order by score desc, part, value, confidence) - 1 as rank from ac)"
_AXIS_SQL = (
    AXIS_CANDS.cte, _RANKED,
    "ded as (select filename, position as p, value as v, arg_min(rank, struct_pack(a := -score, b := rank)) as rank, max(score) as score, arg_min(confidence, struct_pack(a := -score, b := rank)) as conf, min(rank) as fr from rk where value is not null group by 1, 2, 3)",
    "ps as (select filename, position as p, (position - min(position) over (partition by filename)) / greatest(1e-9, max(position) over (partition by filename) - min(position) over (partition by filename)) as t from (select distinct filename, position from rk))",
    "md as (select filename, greatest(coalesce(median(gap), 1.0), 1e-6) as med, count(*) as n from (select filename, t - lag(t) over (partition by filename order by t) as gap from ps) group by filename)",
    "nv as (select filename, count(distinct p) as nv from ded group by filename)",
    "an as (select ded.*, t from ded join ps using (filename, p) where fr < 5)",
    """mo as (select a.filename, a.p as pi, b.p as pj, a.fr as ri, b.fr as rj, abs(b.t - a.t) as span, (b.v - a.v) / (b.t - a.t) as slope, a.v - (b.v - a.v) / (b.t - a.t) * a.t as cut
       from an a join an b on a.filename = b.filename and a.p < b.p and abs(b.t - a.t) >= 0.20 and abs(b.v - a.v) >= 1e-12)""",
    "ms as (select mo.*, greatest(abs(slope) * med, 1e-6) as step, greatest(0.26 * greatest(abs(slope) * med, 1e-6), 0.04) as tol, row_number() over () as mid from mo join md using (filename))",
    """hit as (select mid, p, min(struct_pack(r := abs(v - (slope * t + cut)), s := -score, k := rank, c := conf, v := v)) as b from ms join ded using (filename) join ps using (filename, p) group by mid, p)""",
    """sc as (select ms.*, e.n_in, e.total from ms join (select m.mid, count(*) filter (where b.r <= tol) as n_in,
         round_even((14.0 * count(*) filter (where b.r <= tol) + 3.0 * coalesce(sum(least(1, greatest(0, b.c / 100))) filter (where b.r <= tol), 0) + 5.0 * any_value(span) - coalesce(sum(b.r / step) filter (where b.r <= tol), 0)) * 1e9, 0) / 1e9 as total
       from ms m join hit using (mid) group by m.mid) e using (mid))""",
    "be as (select * from sc qualify row_number() over (partition by filename order by total desc, pi, pj, ri, rj) = 1)",
    "acc as (select be.*, nv, n_in >= greatest(3, ceil(0.60 * nv)) and span >= 0.35 as ok from be join nv using (filename))",
    "pk as (select acc.filename, count(*) filter (where b.r <= tol) as n_sel, count(*) filter (where b.r <= tol and b.k > 0) as n_alt, cast(round_even(sum(b.v) filter (where b.r <= tol), 0) as bigint) as vsum from acc join hit using (mid) where ok group by acc.filename)",
    "dr as (select filename, cast(sum(v) as bigint) as vsum from (select filename, p, arg_min(v, rank) as v from ded group by 1, 2) group by filename)",
)


@query(with_(*_AXIS_SQL, select=f"""select md.filename, cast(md.n as bigint) as n_positions, coalesce(nv.nv, 0) as n_with_candidates,
   case when coalesce(nv.nv, 0) < 2 then 'INSUFFICIENT' when acc.filename is null or not acc.ok then 'AMBIGUOUS' when md.n > n_sel then 'PARTIAL_UNREADABLE' when n_alt > 0 then 'SELECTED_BY_COHERENCE' else 'COHERENT_DIRECT' end as status,
   case when coalesce(nv.nv, 0) < 2 then coalesce(nv.nv, 0) else coalesce(n_in, 0) end as n_inliers, {r6('coalesce(acc.span, 0.0)')} as anchor_span, {r6('acc.slope')} as slope,
   case when acc.ok then n_sel else coalesce(nv.nv, 0) end as n_selected, md.n - case when acc.ok then n_sel else coalesce(nv.nv, 0) end as n_unreadable, coalesce(case when acc.ok then pk.vsum else dr.vsum end, 0) as value_sum
   from md left join nv using (filename) left join acc using (filename) left join pk using (filename) left join dr using (filename)"""))
def g14_select_axis_values(spark, sf):
    from pyspark.sql import Window

    c = AXIS_CANDS.spark(spark, sf)
    w = Window.partitionBy("filename", "position", F.col("value").isNull()).orderBy(F.desc("score"), "part", "value", "confidence")
    c = c.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
    a = K.select_axis_values(c, "filename", anchors_each=5)
    total = F.aggregate(F.array_compact("values"), F.lit(0.0), lambda x, y: x + y)
    return a.select("filename", "n_positions", "n_with_candidates", "status", "n_inliers", rint_round(F.col("anchor_span")).alias("anchor_span"), rint_round(F.col("slope")).alias("slope"), "n_selected", "n_unreadable", F.rint(total).cast("bigint").alias("value_sum"))


# ------------------------------------------------------------------------------------------ votes
VOTES = Derived("vt", "events", {"axis_id": "user_id * 24 + hour(ts)", "region": "event_id % 5", "preprocess": "event_type", "psm": "event_id % 7", "exponent": "case when value < 20 then 3 when value < 60 then 6 else 9 end", "confidence": "cast(event_id * 37 % 101 as double)",
                               "raw": "concat(case when value < 20 then ' mil ' when value < 60 then 'Milhões' else 'BI.' end, event_type)", "normalized": "case when value < 20 then 'mil' when value < 60 then 'milhoes' else 'bi' end"})


@query(with_(
    VOTES.cte,
    "o as (select axis_id, region, preprocess, psm, exponent, max(confidence) as c, min(struct_pack(c := -confidence, raw := raw, normalized := normalized)) as t from vt group by all)",
    "w as (select *, case when c <= 20 then 0.0::double else least(1.0::double, (c - 20) / 70) end as wt from o)",
    "p as (select axis_id, exponent, round_even(sum(wt) * 1e9, 0) / 1e9 as weight, count(*) filter (where wt > 0) as eligible, max(c) as conf, count(*) as n, min(t) as t from w group by all)",
    "b as (select *, row_number() over (partition by axis_id order by weight desc, eligible desc, conf desc, exponent) as rn, sum(weight) over (partition by axis_id) as total, sum(n) over (partition by axis_id) as nv, sum(eligible) over (partition by axis_id) as ne from p)",
    "r as (select b.*, coalesce((select max(conf) from p where p.axis_id = b.axis_id and p.exponent <> b.exponent), -1) as rival, case when total > 0 then weight / total else 0 end as share from b where rn = 1)",
    "d as (select *, eligible >= 2 and share >= 0.65 and conf >= 45 as agreed, conf >= 82 and rival < 45 as single from r)",
    "axes as (select user_id * 24 + unnest(range(24)) as axis_id from (select distinct user_id from events))",
    select=f"""select axes.axis_id, case when d.axis_id is null then 'NONE' when agreed or single then 'CONFIDENT' else 'AMBIGUOUS' end as scale_status, case when agreed then 'CONSENSUS' when single then 'SINGLE_HIGH_CONF' else '' end as route, coalesce(t.raw, '') as scale_text_raw, coalesce(t.normalized, '') as scale_text_normalized, exponent as scale_exponent,
   case when agreed or single then pow(10.0::double, exponent) else 1.0::double end as scale_factor, coalesce(conf, -1.0) as confidence, cast(coalesce(nv, 0) as bigint) as n_votes, cast(coalesce(ne, 0) as bigint) as n_eligible, coalesce(n, 0) as winning_votes, coalesce(eligible, 0) as winning_eligible,
   {r6('coalesce(share, 0.0)')} as weight_share, cast(coalesce(rival, -1) as double) as rival_confidence from axes left join d on d.axis_id = axes.axis_id"""))
def g15_scale_vote(spark, sf):
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    axes = table(spark, sf, "events").select("user_id").distinct().select("user_id", hours.alias("h")).select((F.col("user_id") * 24 + F.col("h")).alias("axis_id"))
    return K.scale_vote(VOTES.spark(spark, sf), "axis_id", axes)


_LABEL = r"trim(regexp_replace(regexp_replace(upper(strip_accents(coalesce(p_name, ''))), '[^A-Z0-9/%+\-.,() ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_PHRASE = lambda t: rf"least(8.0::double, 0.12::double * length(regexp_replace({t}, '[^A-Z]', '', 'g')) + 0.9::double * greatest(0, len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: regexp_matches(w, '[A-Z]'))) - 1))"
SLOT_SQL = (
    f"rd as (select p_brand as filename, p_size as slot, p_type as source, case p_partkey % 3 when 0 then 'gray' when 1 then 'otsu' else 'adaptive' end || '|' || (p_partkey % 7) || '|' || (p_partkey % 4) as variant, {_LABEL} as text, p_retailprice / 10 as b, cast(p_partkey * 13 % 101 as double) as c from part)",
    "ds as (select filename, slot, source, variant, text, max(struct_pack(b := b, c := c)) as m from rd where length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 2 group by all)",
    f"rs as (select filename, slot, source, variant, text, m.b as b, m.c as c, m.b + {_PHRASE('text')} as rank, row_number() over (partition by filename, slot order by -m.b, text, variant, source, m.c) as i from ds)",
    # longest matching blocks, the earliest in the text and then in the face, and what lies before and after them
    "tp as (select distinct x.text as a, y.text as b from rs x join rs y on x.filename = y.filename and x.slot = y.slot and x.text <> y.text)",
    "ce as (select a, b, i, j from (select a, b, i, unnest(range(1, length(b) + 1)) as j from (select a, b, unnest(range(1, length(a) + 1)) as i from tp)) where substr(a, cast(i as integer), 1) = substr(b, cast(j as integer), 1))",
    "ru as (select a, b, i, j, max(i) over (partition by a, b, i - j, isl) - i + 1 as run from (select *, i - row_number() over (partition by a, b, i - j order by i) as isl from ce))",
    """rg as (select a, b, cast(1 as bigint) as al, cast(length(a) + 1 as bigint) as ah, cast(1 as bigint) as bl, cast(length(b) + 1 as bigint) as bh, cast(0 as bigint) as k from tp union all
       select a, b, x.al, x.ah, x.bl, x.bh, x.k from (select a, b, unnest([struct_pack(al := al, ah := m.i, bl := bl, bh := m.j, k := m.k), struct_pack(al := m.i + m.k, ah := ah, bl := m.j + m.k, bh := bh, k := cast(0 as bigint))]) as x
         from (select rg.a, rg.b, al, ah, bl, bh, arg_min(struct_pack(i := i, j := j, k := least(run, ah - i, bh - j)), struct_pack(nk := -least(run, ah - i, bh - j), i := i, j := j)) as m
               from rg join ru on ru.a = rg.a and ru.b = rg.b and i >= al and i < ah and j >= bl and j < bh group by rg.a, rg.b, al, ah, bl, bh)))""",
    "al as (select a, b from rg group by a, b having 2.0::double * sum(k) / (length(a) + length(b)) >= 0.72)",
    "sl0 as (select filename, slot, list(text order by i) as ts, list(rank order by i) as rk from rs group by all)",
    "si as (select filename, slot, list(distinct a || '|' || b) as alike from (select x.filename, x.slot, al.a, al.b from rs x join al on al.a = x.text) group by all)",
    # readings join the first group whose face they resemble
    """fo as (select filename, slot, ts, rk, coalesce(alike, []) as alike, cast(0 as bigint) as n, cast([] as struct(r double, t varchar)[]) as faces, cast([] as bigint[]) as gs from sl0 left join si using (filename, slot) union all
       select filename, slot, ts, rk, alike, n + 1, case when g is null then faces || [struct_pack(r := rk[n + 1], t := ts[n + 1])] when rk[n + 1] > faces[g].r then faces[1:g - 1] || [struct_pack(r := rk[n + 1], t := ts[n + 1])] || faces[g + 1:] else faces end, gs || [coalesce(g, len(faces) + 1)]
       from (select *, nullif(list_position(list_transform(faces, lambda f: f.t = ts[n + 1] or list_contains(alike, ts[n + 1] || '|' || f.t)), true), 0) as g from fo where n < len(ts)))""",
    "nu as (select filename, slot, unnest(gs) as g, generate_subscripts(gs, 1) as i from fo where n = len(ts))",
    "gp as (select filename, slot, g, arg_max(text, struct_pack(rank := rank, e := -rs.i)) as face, max(b) as base, max(c) as conf, count(distinct variant) as variants, count(distinct source) as sources from nu join rs using (filename, slot, i) group by all)",
    f"sc as (select *, base + least(34.0::double, 2.0::double * variants + 4.0::double * sources) + {_PHRASE('face')} as score from gp)",
    "tw as (select *, row_number() over (partition by filename, slot order by score desc, g) as rn, lead(score) over (partition by filename, slot order by score desc, g) as score2, lead(variants) over (partition by filename, slot order by score desc, g) as variants2 from sc)",
    """dc as (select *, case when chars > 0 then letters / chars else 0 end as alpha, coalesce(score - score2 < 5, false) as close, coalesce(variants >= 8 and conf >= 90 and (score2 is null or variants >= 1.5 * greatest(1, variants2)), false) as strong
       from (select *, length(regexp_replace(face, '[^A-Za-z0-9]', '', 'g')) as chars, length(regexp_replace(face, '[^A-Z]', '', 'g')) as letters from tw where rn = 1))""",
    """st as (select *, case when variants >= 2 and alpha >= 0.55 then case when close and not strong then 'AMBIGUOUS' else 'CONSENSUS' end when conf >= 88 and alpha >= 0.65 then case when close then 'AMBIGUOUS' else 'SINGLE_HIGH_CONF' end else 'UNREADABLE' end as status from dc)""",
)


@query("with recursive " + ",\n".join(SLOT_SQL) + f""" select e.filename, e.slot as slot_index, coalesce(status, 'UNREADABLE') as status, case when status in ('CONSENSUS', 'SINGLE_HIGH_CONF') then face else '' end as selected_text,
   {r6('coalesce(score, 0.0)')} as score, coalesce(variants, 0) as support, coalesce(conf, -1.0) as confidence from (select distinct filename, slot from rd) e left join st using (filename, slot)""")
def g16_slot_consensus(spark, sf):
    p = table(spark, sf, "part").selectExpr(
        "p_brand as filename", "p_size as slot_index", "p_type as source", "case p_partkey % 3 when 0 then 'gray' when 1 then 'otsu' else 'adaptive' end as preprocess",
        "p_partkey % 7 as rotation", "p_partkey % 4 as psm", "p_name as text", "p_retailprice / 10 as base_score", "cast(p_partkey * 13 % 101 as double) as ocr_confidence",
    )
    return K.slot_consensus(p, ["filename", "slot_index"])


SLOTS = Derived("sl", "lineitem", {"filename": "l_orderkey", "status": "case when l_discount < 0.02 then 'UNREADABLE' when l_discount < 0.03 then 'AMBIGUOUS' when l_tax < 0.04 then 'SINGLE_HIGH_CONF' else 'CONSENSUS' end"})


@query(with_(SLOTS.cte, EVERY, select="""select every.filename, case when bool_and(status in ('CONSENSUS','SINGLE_HIGH_CONF')) then 'CATEGORICAL_COMPLETE' when bool_or(status = 'AMBIGUOUS') then 'CATEGORICAL_AMBIGUOUS'
   when bool_or(status = 'UNREADABLE') and bool_or(status in ('CONSENSUS','SINGLE_HIGH_CONF')) then 'CATEGORICAL_PARTIAL' else 'CATEGORICAL_FAILED' end as axis_status from every left join sl on sl.filename = every.filename group by every.filename"""))
def g17_axis_slot_status(spark, sf):
    return K.axis_slot_status(SLOTS.spark(spark, sf), "filename", "status", every(spark, sf))


# ------------------------------------------------------------------------------------------ overall
TECH_STATUS = "case when o_orderpriority = '1-URGENT' and o_totalprice > 480000 then 'UNEVALUABLE_SPEC_CONFLICT' when o_totalprice < 20000 then 'NONCONFORMING' else 'CONFORMING' end"
DIMS = ["mark_status", "axis_status", "color_status", "tick_status", "technique_status", "content_status"]


RATE_SQL = "count(*) filter (where s = 'CONFORMING') / nullif(count(*) filter (where s in ('CONFORMING','NONCONFORMING')), 0)"
OVERALL = (
    *INTEGRATED, *BB, f"tq as (select o_orderkey as filename, {TECH_STATUS} as technique_status from orders)",
    "j as (select i.filename, mark_status, axis_status, color_status, tick_status, technique_status, res.bb_collapsed_status as content_status from integrated i join tq using (filename) join res using (filename))",
    f"""overall as (select filename, case when 'UNEVALUABLE_SPEC_CONFLICT' in ({', '.join(DIMS)}) then 'UNEVALUABLE_SPEC_CONFLICT' when 'NONCONFORMING' in ({', '.join(DIMS)}) then 'NONCONFORMING'
   when {' and '.join(f"{d} in ('CONFORMING','NOT_SPECIFIED')" for d in DIMS)} then 'CONFORMING' else 'UNEVALUABLE' end as overall from j)""",
)


@query(with_(*OVERALL, select="select filename, overall from overall"))
def g18_overall_strict(spark, sf):
    tech = table(spark, sf, "orders").selectExpr("o_orderkey as filename", f"{TECH_STATUS} as technique_status")
    content = bb_results(spark, sf).select("filename", F.col("bb_collapsed_status").alias("content_status"))
    j = integrated(spark, sf).join(tech, "filename").join(content, "filename")
    return j.select("filename", S.overall_strict([F.col(d) for d in DIMS]).alias("overall"))


@query(with_(*OVERALL, UNIT, select=f"""select profile, count(*) filter (where s = 'CONFORMING') as n_conforming, count(*) filter (where s = 'NONCONFORMING') as n_nonconforming, count(*) filter (where s = 'UNEVALUABLE') as n_unevaluable,
   count(*) filter (where s = 'UNEVALUABLE_SPEC_CONFLICT') as n_spec_conflict, {r6(RATE_SQL)} as rate_evaluable
   from (select u.profile, i.overall as s from overall i join orders o on o.o_orderkey = i.filename left join unit u on u.unit_id = o.o_custkey) group by profile"""))
def d22_rate_among_evaluable(spark, sf):
    facts = image_facts(spark, sf).select("filename", "unit_id")
    j = g18_overall_strict(spark, sf).join(facts, "filename")
    return R.evaluable_rates(I.attach(j, units(spark, sf), "unit_id", ["profile"]), "profile", "overall")


@query(with_(*VALID, select="select filename, manual4, observed, match from vd"))
def g24_validation_match(spark, sf):
    return validated(spark, sf).select("filename", "manual4", "observed", "match")


# ------------------------------------------------------------------------------------------- layout
FRAME_GROUPS = Derived("fg", "lineitem", {
    "filename": "l_orderkey", "orient": "case when l_returnflag = 'N' then 'V' else 'H' end",
    "a": "case when l_returnflag = 'N' then 80 + l_partkey % 30 else 90 + l_partkey % 40 end", "b": "case when l_returnflag = 'N' then 640 + l_suppkey % 40 else 1000 + l_suppkey % 200 end",
    "c": "case when l_returnflag = 'N' then 100 + l_partkey % 1050 else 5 + l_partkey % 780 end",
})


@query(with_(
    FRAME_GROUPS.cte, EVERY,
    "k as (select *, case when orient = 'H' then a between 18.0 and 1194.0 and b between 18.0 and 1194.0 and c between 12.0 and 788.0 else c between 18.0 and 1194.0 and a between 12.0 and 788.0 and b between 12.0 and 788.0 end as good from fg)",
    """g as (select filename, count(*) filter (where good and orient = 'H') as n_h, count(*) filter (where good and orient = 'V') as n_v,
      round_even(median(a) filter (where good and orient = 'H'), 0) as hl, round_even(median(b) filter (where good and orient = 'H'), 0) as hr, round_even(median(a) filter (where good and orient = 'V'), 0) as vt, round_even(median(b) filter (where good and orient = 'V'), 0) as vb,
      min(c) filter (where good and orient = 'V') as vmin, max(c) filter (where good and orient = 'V') as vmax, min(c) filter (where good and orient = 'H') as hmin, max(c) filter (where good and orient = 'H') as hmax,
      stddev_pop(a) filter (where good and orient = 'H') / 1200 as s1, stddev_pop(b) filter (where good and orient = 'H') / 1200 as s2, stddev_pop(a) filter (where good and orient = 'V') / 800 as s3, stddev_pop(b) filter (where good and orient = 'V') / 800 as s4 from k group by filename)""",
    """e as (select *, cast(case when n_h >= 2 then hl when n_v >= 2 then vmin end as double) as "left", cast(case when n_h >= 2 then hr when n_v >= 2 then vmax end as double) as "right",
      cast(case when n_v >= 2 then vt when n_h >= 2 then hmin end as double) as top, cast(case when n_v >= 2 then vb when n_h >= 2 then hmax end as double) as bottom,
      list_avg(list_filter([s1, s2, s3, s4], lambda x: x is not null)) as spread from g)""",
    select=f"""select every.filename, coalesce(n_h, 0) as n_h, coalesce(n_v, 0) as n_v, "left", "right", top, bottom, case when "left" is null or top is null then 'INCOMPLETE' when "right" <= "left" or bottom <= top then 'INVALID_GEOMETRY'
      when ("right" - "left") / 1200 < 0.35 or (bottom - top) / 800 < 0.35 then 'LOW_CONFIDENCE' else 'OK' end as status, {r6('spread')} as spread_norm, coalesce({r6('greatest(0.0::double, 1.0 - 4.0 * spread)')}, 0.0) as confidence from every left join e on e.filename = every.filename"""))
def g28_plot_frame_consensus(spark, sf):
    return G.plot_frame(FRAME_GROUPS.spark(spark, sf), "filename", 1200.0, 800.0, every(spark, sf))


BASES = Derived("c", "lineitem", {"filename": "l_orderkey", "pos": "cast(600 + l_partkey % 60 as double)", "area": "l_quantity"})


@query("with recursive " + ",\n".join([
    BASES.cte,
    "it as (select filename, pos as p, sum(area) as a, count(*) as m, row_number() over (partition by filename order by pos) as rn from c group by filename, pos)",
    """fold as (select filename, rn, cast(0 as bigint) as grp, list_resize([p], m, p) as ps from it where rn = 1
       union all select j.filename, j.rn, case when abs(j.p - list_median(f.ps)) <= 11 then f.grp else f.grp + 1 end, case when abs(j.p - list_median(f.ps)) <= 11 then list_concat(f.ps, list_resize([j.p], j.m, j.p)) else list_resize([j.p], j.m, j.p) end
       from fold f join it j on j.filename = f.filename and j.rn = f.rn + 1)""",
    "gr as (select filename, grp, sum(a) as a, cast(sum(m) as bigint) as n, arg_max(ps, rn) as ps from it join fold using (filename, rn) group by filename, grp)",
    "sc as (select *, a * (1 + 0.1::double * (n - 1)) as score, count(*) over (partition by filename) as n_clusters from gr)",
]) + f" select filename, cast(round_even(list_median(ps), 0) as bigint) as baseline, n as n_bars, {r6('score')} as score, n_clusters from sc qualify row_number() over (partition by filename order by score desc, grp) = 1")
def g29_baseline_cluster(spark, sf):
    return O.running_median_groups(BASES.spark(spark, sf), "filename", "pos", "area", F.lit(11.0))


LABEL_BOXES = Derived("lb", "lineitem", {"filename": "l_orderkey", "axis": "case when l_returnflag = 'A' then 'X' else 'Y' end", "x1": "cast(l_partkey % 110 as double)", "x2": "cast(l_partkey % 110 as double) + l_quantity", "y1": "cast(640 + l_suppkey * 3 % 90 - l_linenumber * 60 as double)", "y2": "cast(652 + l_suppkey * 3 % 90 - l_linenumber * 60 as double)"})
LANE_FRAMES = Derived("lf", "orders", {"filename": "o_orderkey", "pl": "case when o_orderstatus <> 'P' or o_totalprice > 100000 then cast(100 as double) end", "pr": "cast(1100 as double)", "pt": "cast(90 as double)", "pb": "cast(660 as double)"})


@query(with_(
    LABEL_BOXES.cte, LANE_FRAMES.cte,
    """d as (select lb.*, pl is not null as known, case when axis = 'Y' then (y1 + y2) / 2 between pt - 19.95 and pb + 19.95 else (x1 + x2) / 2 between pl - 35.0 and pr + 35.0 end as along,
       case when axis = 'Y' then pl - x2 else y1 - pb end as away, case when axis = 'Y' then greatest(8.0, 0.022 * (pr - pl)) else greatest(8.0, 0.020 * (pb - pt)) end as tol from lb left join lf using (filename))""",
    "e as (select *, coalesce(known and along, false) as al, case when known and along and away >= -4 then abs(away) end as dist from d)",
    "f as (select *, min(dist) over (partition by filename, axis) as ref from e)",
    "g as (select filename, axis, count(*) as n_before, bool_and(known) as known, count(*) filter (where al) as n_along, count(*) filter (where dist <= ref + tol) as n_near, min(ref) as ref from f group by 1, 2)",
    select="""select filename, axis, n_before, n_along, case when not known then n_before when ref is null then n_along else n_near end as n_after, ref as reference_distance,
      case when not known then 'UNAVAILABLE' when n_along = 0 then 'LONGITUDINAL_EMPTY' when ref is null then 'LONGITUDINAL_ONLY' when n_near < n_along then 'FILTERED_2D' when n_before > n_along then 'LONGITUDINAL_FILTERED' else 'UNCHANGED' end as status from g"""))
def g30_tick_lane_filter(spark, sf):
    frames = LANE_FRAMES.spark(spark, sf).selectExpr("filename", "pl as left", "pr as right", "pt as top", "pb as bottom")
    return G.tick_lane(LABEL_BOXES.spark(spark, sf), frames, "filename")


SMALL = Derived("sb", "lineitem", {"filename": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "size": "l_quantity", "cross_size": "cast(4 + l_linenumber * 2 as double)"})


@query(with_(SMALL.cte, "m as (select filename, median(size) filter (where size > 0) as ms, median(cross_size) as mc from sb group by filename)",
             select="select sb.* from sb join m using (filename) where ms is not null and not (size < greatest(8.0, 0.22 * ms) and cross_size < 0.70 * greatest(8.0, mc))"))
def g31_small_box_filter(spark, sf):
    return G.small_boxes_dropped(SMALL.spark(spark, sf), "filename", "size", "cross_size")


BLOCKS = Derived("bl", "lineitem", {
    "filename": "l_orderkey", "l_partkey": "l_partkey", "axis": "case when l_returnflag = 'A' then 'X' else 'Y' end", "cx": "cast(l_partkey * 7 % 1200 as double)", "cy": "cast(640 + l_suppkey * 3 % 150 as double)", "w": "l_quantity", "h": "cast(l_linenumber * 15 as double)",
    "glyph": "cast(12 as double)", "pl": "cast(100 as double)", "pr": "cast(1100 as double)", "la": "cast(100 as double)", "ba": "cast(660 as double)",
})


@query(with_(BLOCKS.cte, select="""select filename, l_partkey, axis, cx, cy from bl where case when axis = 'X' then abs(cx - (pl + pr) / 2) / greatest(1.0, pr - pl) <= 0.25 and cy - ba >= 1.2 * glyph
   else la - cx >= 1.2 * glyph and h > 1.8 * greatest(1.0, w) end"""))
def g32_axis_label_candidates(spark, sf):
    b = BLOCKS.spark(spark, sf).withColumnsRenamed({"pl": "left", "pr": "right", "la": "left_axis", "ba": "bottom_axis"})
    return G.axis_label_blocks(b).select("filename", "l_partkey", "axis", "cx", "cy")
