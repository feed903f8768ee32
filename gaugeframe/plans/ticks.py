"""Axis content against its specification: comparison, summaries, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import text as T
from gaugeframe.functions.numbers import rint_round
from gaugeframe.operators import integrate as I
from gaugeframe.operators import multiset as M
from gaugeframe.operators import tick_compare as TC
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import UNIT, Derived, r6, table, units, with_

# copies of a specified line that were read: none, one or two
COPIES = "case when l_returnflag = 'R' and l_discount < 0.03 then 0 when l_tax >= 0.07 then 2 else 1 end"

# ------------------------------------------------------------------------------------ plain multiset
F05_COUNTS = (
    f"ln as (select l_orderkey as filename, l_linenumber as v, {COPIES} as copies from lineitem)",
    "cnt as (select filename, v, count(*) as e, cast(sum(copies) as bigint) as o from ln group by all)",
    "per as (select filename, cast(sum(e) as bigint) as n_expected, cast(sum(o) as bigint) as n_observed, cast(sum(greatest(e - o, 0)) as bigint) as n_missing, cast(sum(greatest(o - e, 0)) as bigint) as n_extra from cnt group by filename)",
    "mi as (select filename, string_agg(cast(v as varchar), ' | ' order by v) as items from (select filename, v, unnest(range(e - o)) from cnt where e > o) group by filename)",
    "xi as (select filename, string_agg(cast(v as varchar), ' | ' order by v) as items from (select filename, v, unnest(range(o - e)) from cnt where o > e) group by filename)",
)


def line_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ln = table(spark, sf, "lineitem").selectExpr("l_orderkey as filename", "l_linenumber as v", f"{COPIES} as copies")
    return ln.select("filename", "v"), ln


@query(with_(*F05_COUNTS, select="""select filename, n_expected, n_observed, n_missing, n_extra, coalesce(mi.items, '') as missing_items, coalesce(xi.items, '') as extra_items,
   case when n_missing = 0 and n_extra = 0 then 'NORMALIZED_EQUIVALENT' when n_extra = 0 then 'NONCONFORMING_MISSING' when n_missing = 0 then 'NONCONFORMING_EXTRA' else 'NONCONFORMING_VALUE' end as detailed,
   case when n_missing = 0 and n_extra = 0 then 'CONFORMING' else 'NONCONFORMING' end as collapsed from per left join mi using (filename) left join xi using (filename)"""))
def f05_multiset_compare(spark, sf):
    expected, observed = line_lists(spark, sf)
    return M.compare(M.value_counts(expected, observed, ["filename"], "v", weight="copies"), ["filename"], "v")


# --------------------------------------------------------------------------------------- flagship
AXIS_ROWS = Derived("ax", "orders", {
    "filename": "o_orderkey", "unit_id": "o_custkey",
    "axis": "case when o_orderkey % 2 = 0 then 'X' else 'Y' end",
    "kind": "case o_orderkey % 3 when 0 then 'categorical' when 1 then 'temporal' else 'numeric' end",
    "scope": "case o_orderkey % 11 when 0 then 'EXAMPLES_ONLY' when 1 then 'NOT_SPECIFIED' else 'EXHAUSTIVE' end",
    "status": "case o_orderkey % 13 when 0 then 'REVIEW_SPEC' when 1 then 'READY_TEMPORAL' when 2 then 'DRAFT' else case when o_orderkey % 3 = 1 then 'READY_TEMPORAL' else 'READY_LIST' end end",
    "eligible": "case when o_orderstatus = 'P' then 'NO' else 'YES' end",
})
EXPECTED = "case l_orderkey % 3 when 0 then concat('infraestrutura e ', cast(l_linenumber as string)) when 1 then cast(2000 + l_linenumber as string) else concat('NUM:', cast(l_linenumber * cast(1000 as double) as string)) end"
RAW = "case l_orderkey % 3 when 0 then concat(' Infra-Estrutura /  ', cast(l_linenumber as string)) when 1 then concat(' ', cast(2000 + l_linenumber as string)) else concat('R$ ', cast(l_linenumber as string), ' Mil') end"
OBSERVED_SQL = r"""case k when 0 then trim(regexp_replace(regexp_replace(replace(trim(lower(strip_accents(raw))), 'infra-estrutura', 'infraestrutura'), '\s*/\s*', ' e ', 'g'), '\s+', ' ', 'g'))
   when 1 then trim(raw) else 'NUM:' || cast(cast(regexp_extract(raw, '(\d+)', 1) as double) * 1000 as varchar) end"""
# every (kind, outcome) with its words, stated row by row
_WORDS = TC.REASONS
REASON_SQL = "case " + " ".join(
    f"when {cond} then '{words}'" for cond, words in [
        *[(f"denominator_eligible = 'YES' and kind = '{k}' and bb_detailed_status {op} 'NORMALIZED_EQUIVALENT'", _WORDS[k][w]) for k in TC.KINDS for op, w in (("=", "same"), ("<>", "different"))],
        ("bb_detailed_status = 'NOT_EVALUATED' and kind = 'categorical'", _WORDS["categorical"]["scope"]),
        ("bb_detailed_status = 'NOT_EVALUATED' and scope = 'EXAMPLES_ONLY'", _WORDS["other"]["examples"]),
        ("bb_detailed_status = 'NOT_EVALUATED' and scope = 'NOT_SPECIFIED'", _WORDS["other"]["scope"]),
        ("bb_detailed_status = 'NOT_EVALUATED'", _WORDS["other"]["not_ready"]),
        ("bb_detailed_status = 'UNEVALUABLE_SPEC_REVIEW' and kind = 'categorical'", _WORDS["categorical"]["review"]),
        ("bb_detailed_status = 'UNEVALUABLE_SPEC_REVIEW'", _WORDS["other"]["review"]),
        *[(f"bb_detailed_status = 'UNEVALUABLE' and kind = '{k}'", _WORDS[k]["unread"]) for k in TC.KINDS],
    ]
) + " end"
BB = (
    AXIS_ROWS.cte,
    f"raw as (select l_orderkey as filename, l_orderkey % 3 as k, {EXPECTED} as expected, {RAW} as raw, {COPIES} as copies from lineitem)",
    f"ev as (select filename, expected as v, count(*) as e from raw group by all)",
    f"ov as (select filename, {OBSERVED_SQL} as v, cast(sum(copies) as bigint) as o from raw group by all)",
    "cnt as (select filename, v, coalesce(e, 0) as e, coalesce(o, 0) as o from ev full join ov using (filename, v))",
    "per as (select filename, cast(sum(o) as bigint) as n_observed, sum(greatest(e - o, 0)) as nm, sum(greatest(o - e, 0)) as nx from cnt group by filename)",
    "mi as (select filename, string_agg(v, ' | ' order by v) as items from (select filename, v, unnest(range(e - o)) from cnt where e > o) group by filename)",
    "xi as (select filename, string_agg(v, ' | ' order by v) as items from (select filename, v, unnest(range(o - e)) from cnt where o > e) group by filename)",
    """gated as (select ax.*, coalesce(nm, 0) as nm, coalesce(nx, 0) as nx, coalesce(mi.items, '') as m_items, coalesce(xi.items, '') as x_items,
      case when kind = 'categorical' then case when scope <> 'EXHAUSTIVE' then 'NOT_EVALUATED' when status like 'REVIEW\\_%' escape '\\' then 'UNEVALUABLE_SPEC_REVIEW' when eligible <> 'YES' then 'UNEVALUABLE' end
        when scope in ('NOT_SPECIFIED','EXAMPLES_ONLY') then 'NOT_EVALUATED' when status like 'REVIEW\\_%' escape '\\' then 'UNEVALUABLE_SPEC_REVIEW'
        when kind = 'temporal' and status <> 'READY_TEMPORAL' then 'NOT_EVALUATED' when kind = 'numeric' and not starts_with(status, 'READY_') then 'NOT_EVALUATED'
        when coalesce(n_observed, 0) = 0 then 'UNEVALUABLE' end as closed
      from ax left join per using (filename) left join mi using (filename) left join xi using (filename))""",
    """bb as (select filename, unit_id, axis, kind, scope, status, eligible,
      coalesce(closed, case when nm = 0 and nx = 0 then 'NORMALIZED_EQUIVALENT' when nx = 0 then 'NONCONFORMING_MISSING' when nm = 0 then 'NONCONFORMING_EXTRA' else 'NONCONFORMING_VALUE' end) as bb_detailed_status,
      case when closed is null then 'YES' else 'NO' end as denominator_eligible, case when closed is null then m_items else '' end as missing_items, case when closed is null then x_items else '' end as extra_items from gated)""",
    f"""res as (select *, case when kind = 'categorical' then 'BA_CAT_PRODUCTION' else 'BA_V7_PRODUCTION' end as source_batch, 'B_B_NORMALIZATION_V1' as normalization_version, {REASON_SQL} as bb_reason,
      case when bb_detailed_status = 'NORMALIZED_EQUIVALENT' then 'CONFORMING' when bb_detailed_status like 'NONCONFORMING%' then 'NONCONFORMING'
      when bb_detailed_status = 'NOT_EVALUATED' then 'NOT_SPECIFIED' else 'UNEVALUABLE' end as bb_collapsed_status from bb)""",
)


def bb_results(spark: SparkSession, sf: str) -> DataFrame:
    """Specification and observation are separate tables that meet only in the comparison."""
    li = table(spark, sf, "lineitem")
    expected = li.selectExpr("l_orderkey as filename", f"{EXPECTED} as v")
    raw = li.selectExpr("l_orderkey as filename", "l_orderkey % 3 as k", f"{RAW} as raw", f"{COPIES} as copies")
    read = raw.withColumn("number", F.when(F.col("k") == 2, TC.number_and_unit(F.col("raw"))))
    value = rint_round(F.col("number.value") * T.unit_multiplier(F.col("number.unit")))
    observed = read.select(
        "filename", "copies",
        F.when(F.col("k") == 0, T.cat_label(F.col("raw")))
        .when(F.col("k") == 1, F.trim("raw"))
        .otherwise(F.concat(F.lit("NUM:"), value.cast("string")))
        .alias("v"),
    )
    return TC.compare_axes(AXIS_ROWS.spark(spark, sf), expected, observed, "filename", "v", weight="copies")


@query(with_(*BB, UNIT, select="select res.*, profile, condition_code as condition from res left join unit using (unit_id)"))
def g01_bb_compare_counts(spark, sf):
    return with_profile(spark, sf, bb_results(spark, sf)).withColumnRenamed("condition_code", "condition")


def rate_sql() -> str:
    e, c = "count(*) filter (where denominator_eligible = 'YES')", "count(*) filter (where bb_collapsed_status = 'CONFORMING')"
    return f"{e} as eligible, {c} as conforming, count(*) filter (where bb_collapsed_status = 'NONCONFORMING') as nonconforming, count(*) filter (where bb_collapsed_status = 'UNEVALUABLE') as unevaluable, {r6(f'{c} / nullif({e}, 0)')} as conformity_rate"


@query(with_(*BB, select=f"""select kind, count(*) as n_rows, count(*) filter (where scope = 'EXHAUSTIVE') as spec_exhaustive, count(*) filter (where scope = 'EXAMPLES_ONLY') as spec_examples_only,
   count(*) filter (where scope = 'NOT_SPECIFIED') as spec_not_specified, count(*) filter (where bb_detailed_status = 'UNEVALUABLE_SPEC_REVIEW') as spec_review, {rate_sql()} from res group by kind"""))
def d13_bb_summary_by_kind(spark, sf):
    return TC.summary_by_kind(bb_results(spark, sf))


def with_profile(spark, sf, results):
    return I.attach(results, units(spark, sf), "unit_id", ["profile", "condition_code"])


@query(with_(*BB, UNIT, select=f"select profile, axis, kind, count(*) as n_rows, {rate_sql()} from res left join unit using (unit_id) group by profile, axis, kind"))
def d14_bb_summary_profile_axis(spark, sf):
    return TC.summary_by(with_profile(spark, sf, bb_results(spark, sf)), "profile", "axis", "kind")


FINAL_SETS = [["condition_code"], ["kind"], ["profile"], ["profile", "axis", "kind"]]


@query(with_(*BB, UNIT, "j as (select res.*, profile, condition_code from res left join unit using (unit_id))",
             select=" union all ".join("select " + ", ".join(c if c in s else f"null as {c}" for c in ("condition_code", "kind", "profile", "axis")) + f", '{'+'.join(s)}' as level, count(*) as n_rows, {rate_sql()} from j group by " + ", ".join(s) for s in FINAL_SETS)))
def d15_tick_final_summaries(spark, sf):
    return TC.summaries(with_profile(spark, sf, bb_results(spark, sf)), FINAL_SETS)


@query(with_(*BB, select="select filename, kind, bb_detailed_status, bb_collapsed_status, missing_items, extra_items from res where bb_collapsed_status in ('NONCONFORMING', 'UNEVALUABLE')"))
def g25_review_cases(spark, sf):
    return TC.review_cases(bb_results(spark, sf)).select("filename", "kind", "bb_detailed_status", "bb_collapsed_status", "missing_items", "extra_items")


# -------------------------------------------------------------------------------- numeric precedence
READINGS = Derived("n", "orders", {
    "filename": "o_orderkey",
    "manual": "case when o_orderstatus = 'P' then concat(cast(o_orderkey % 9 as string), case when o_orderkey % 4 = 0 then ' mil' else '' end, ' | 0 | ', cast(o_orderkey % 50 as string), ',5', case when o_orderkey % 5 = 0 then '%' else '' end) when o_orderkey % 10 = 3 then 'illegible' else '' end",
    "effective": "case when o_orderstatus = 'F' and o_orderkey % 3 > 0 then concat(cast(o_orderkey % 7 * 1000 as string), ' | x | ', cast(o_orderkey % 11 as string), '.25') end",
    "selected": "case when o_orderkey % 6 > 0 then concat('0 | ', cast(o_orderkey % 8 as string), ' | ', cast(o_orderkey % 5 as string), '.5') end",
    "raw": "case o_orderkey % 5 when 0 then '10 mil 20 k 30 k' when 1 then '5M 6 mil' when 2 then '7 Milhões' when 3 then 'none' end",
})
NUM_CTE = (
    READINGS.cte,
    r"u0 as (select filename, regexp_extract_all(lower(strip_accents(coalesce(raw, ''))), '\d+(?:[\.,]\d+)?\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])\b', 1) as us from n)",
    "u1 as (select filename, unnest(us) as u, generate_subscripts(us, 1) as pos from u0)",
    "dom as (select filename, arg_min(u, struct_pack(a := -c, b := p)) as unit from (select filename, u, count(*) as c, min(pos) as p from u1 group by all) group by filename)",
    "b as (select n.*, coalesce(dom.unit, '') as unit from n left join dom using (filename))",
)


@query(with_(*NUM_CTE, select="select filename, unit from b"))
def g03_dominant_unit(spark, sf):
    return READINGS.spark(spark, sf).select("filename", TC.dominant_unit(F.col("raw")).alias("unit"))


_RX = r"'(-?\d+(?:[\.,]\d+)?)\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])?'"
_F = "case u when 'k' then 1e3::double when 'mil' then 1e3::double when 'm' then 1e6::double when 'milhao' then 1e6::double when 'milhoes' then 1e6::double when 'b' then 1e9::double when 'bilhao' then 1e9::double when 'bilhoes' then 1e9::double when '%' then null else 1.0::double end"


OBS_CTE = (
    "mp as (select filename, unit, unnest(string_split(coalesce(manual, ''), '|')) as part, generate_subscripts(string_split(coalesce(manual, ''), '|'), 1) as pos from b)",
    f"mn as (select filename, unit, pos, regexp_extract(lower(strip_accents(part)), {_RX}, 1) as num, regexp_extract(lower(strip_accents(part)), {_RX}, 2) as u0 from mp)",
    "mv as (select *, cast(replace(num, ',', '.') as double) as v from mn where num <> '')",
    "mu as (select *, case when unit <> '' and not exists_unit then case when v = 0 then '' else unit end else u0 end as u from (select *, bool_or(v <> 0 and u0 <> '') over (partition by filename) as exists_unit from mv))",
    "ep as (select filename, unnest(string_split(coalesce(effective, ''), '|')) as part, generate_subscripts(string_split(coalesce(effective, ''), '|'), 1) as pos from b)",
    "eu as (select filename, pos, try_cast(trim(part) as double) as v, '' as u from ep where try_cast(trim(part) as double) is not null)",
    "sp as (select filename, unit, unnest(string_split(coalesce(selected, ''), '|')) as part, generate_subscripts(string_split(coalesce(selected, ''), '|'), 1) as pos from b)",
    "su as (select filename, pos, try_cast(trim(part) as double) as v, case when try_cast(trim(part) as double) = 0 then '' else unit end as u from sp where try_cast(trim(part) as double) is not null)",
    "al as (select filename, 1 as pr, pos, v, u from mu union all select filename, 2, pos, v, u from eu union all select filename, 3, pos, v, u from su)",
    f"cv as (select filename, pr, pos, case when u = '%' then 'PCT' else 'NUM' end as typ, case when u = '%' then round_even(v * 1e9, 0) / 1e9 else round_even(v * ({_F}) * 1e6, 0) / 1e6 end as x from al)",
)


@query(with_(
    *NUM_CTE, *OBS_CTE,
    "tx as (select filename, pr, string_agg(typ || ':' || cast(cast(round_even(x * 100, 0) as bigint) as varchar), '|' order by pos) as items from cv group by all)",
    "fi as (select filename, min(pr) as pr, arg_min(items, pr) as items from tx group by filename)",
    select="""select b.filename, case pr when 1 then 'MANUAL_ADJUDICATED' when 2 then 'AUTO_VALIDATED' when 3 then 'AUTO_FALLBACK' else 'NONE' end as source,
      case pr when 1 then trim(manual) when 2 then coalesce(selected, '') when 3 then trim(selected) else '' end as display, coalesce(items, '') as items from b left join fi using (filename)"""))
def g02_observed_numeric(spark, sf):
    n = TC.observed_numeric(READINGS.spark(spark, sf), "manual", "effective", "selected", "raw")
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["typ"], F.rint(x["value"] * 100).cast("bigint").cast("string"))), "|")
    return n.select("filename", "source", "display", items.alias("items"))


# ------------------------------------------------------------------------------ the report, whole
_ITEM = {
    0: lambda i: f"concat('infraestrutura e ', cast({i} as string))",
    1: lambda i: f"cast(2000 + {i} as string)",
    2: lambda i: f"case when {i} = 3 then '2.5%' else cast({i} * 1000 as string) end",
}


def _list_of(kind: str, items: dict, n: str) -> str:
    """Up to four items of a kind as delimited text; the same in both dialects."""
    one = lambda k: "concat(" + ", ".join(f"case when {i} <= {n} then concat({chr(39) + ' | ' + chr(39) if i > 1 else chr(39) * 2}, {items[k](i)}) else '' end" for i in (1, 2, 3, 4)) + ")"
    return f"case ({kind}) % 3 when 0 then {one(0)} when 1 then {one(1)} else {one(2)} end"


def _spec(axis: str, shift: int) -> Derived:
    k = f"c_custkey + {shift}"
    ready = f"case ({k}) % 3 when 1 then 'READY_TEMPORAL' else 'READY_LIST' end"
    return Derived(f"sp{axis.lower()}", "customer", {
        "unit_id": "c_custkey", "axis": f"'{axis}'", "scope": f"case ({k}) % 17 when 0 then 'EXAMPLES_ONLY' when 1 then 'NOT_SPECIFIED' else 'EXHAUSTIVE' end",
        "status": f"case ({k}) % 19 when 0 then 'REVIEW_SPEC' when 2 then 'DRAFT' else {ready} end", "display": f"concat('F ', cast(c_custkey as string))",
        "canonical": _list_of(k, _ITEM, "(2 + c_custkey % 3)"), "x_order": "case when c_custkey % 2 = 0 then 'ASCENDING' else 'NOT_SPECIFIED' end",
    }, where="c_custkey % 23 > 0")


SPEC_X, SPEC_Y = _spec("X", 0), _spec("Y", 1)
_READ = {0: lambda i: f"concat(' Infra-Estrutura /  ', cast({i} as string))", 1: _ITEM[1], 2: lambda i: f"case when {i} = 3 then '2,5%' else concat(cast({i} as string), ' mil') end"}
_N_READ = "(2 + o_custkey % 3 - case when o_orderkey % 5 = 0 then 1 else 0 end + case when o_orderkey % 7 = 0 then 1 else 0 end)"
CAT_ROWS = Derived("ct", "orders", {
    "filename": "o_orderkey", "profile": "o_orderstatus", "unit_id": "o_custkey", "condition": "o_orderpriority",
    "extraction_source": "case when o_orderkey % 4 = 0 then 'MANUAL' else 'AUTO' end", "ba_final_status": "case when o_orderkey % 9 = 0 then 'PARTIAL' else 'COMPLETE' end",
    "content": _list_of("0", _READ, _N_READ), "eligible": "case when o_orderkey % 9 = 0 then 'NO' else 'YES' end",
}, where="o_custkey % 3 = 0")
_AXIS_OF = "case when o_orderkey % 2 = 0 then 'x' else 'Y' end"
_KIND_OF = "(o_custkey + o_orderkey % 2) % 3"
FINAL_ROWS = Derived("fr", "orders", {
    "filename": "o_orderkey", "axis": _AXIS_OF, "kind": f"case {_KIND_OF} when 0 then 'categorical' when 1 then 'temporal' else 'numeric' end", "profile": "o_orderstatus", "unit_id": "o_custkey", "condition": "o_orderpriority",
    "manual": f"case when o_orderkey % 3 = 0 then {_list_of('2', _READ, _N_READ)} when o_orderkey % 10 = 3 then 'illegible' else '' end", "manual_result": "case when o_orderkey % 3 = 0 then 'OK' end",
    "years": f"case when o_orderkey % 8 > 0 then {_list_of('1', _READ, _N_READ)} end", "selected": "case when o_orderkey % 6 > 1 then '1 | 2 | 0' end",
})
AXIS_READ = Derived("ar", "orders", {"filename": "o_orderkey", "axis": f"upper({_AXIS_OF})", "raw": "case o_orderkey % 4 when 0 then '1 mil 2 mil' when 1 then '5M' end", "effective": "case when o_orderkey % 4 = 1 then '1000 | x | 2000' end"}, where="o_orderkey % 29 > 0")
_TEXTS = lambda c, f="trim(p)": f"[struct_pack(typ := '', x := 0.0::double, t := {f}) for p in string_split(coalesce({c}, ''), '|') if trim(p) <> '']"
_LABEL = r"trim(regexp_replace(regexp_replace(replace(trim(lower(strip_accents(p))), 'infra-estrutura', 'infraestrutura'), '\s*/\s*', ' e ', 'g'), '\s+', ' ', 'g'))"
_SHOW = lambda c: f"array_to_string([case when i.typ = '' then i.t when i.typ = 'PCT' then printf('%g', i.x) || '%' when abs(i.x - round_even(i.x, 0)) < 1e-9 then cast(cast(round_even(i.x, 0) as bigint) as varchar) else printf('%g', i.x) end for i in {c}], ' | ')"
_MORE = lambda a, b: f"flatten([[v for k in range(greatest(0, len([p for p in {a} if p = v]) - len([q for q in {b} if q = v])))] for v in list_sort(list_distinct({a}))])"
REPORT = (
    SPEC_X.cte, SPEC_Y.cte, CAT_ROWS.cte, FINAL_ROWS.cte, AXIS_READ.cte, "spc as (select * from spx union all select * from spy)",
    "n as (select fr.filename, manual, effective, selected, raw from fr left join ar on ar.filename = fr.filename and ar.axis = upper(fr.axis) where kind = 'numeric')",
    *NUM_CTE[1:], *OBS_CTE,
    "ni as (select filename, pr, list(struct_pack(typ := typ, x := x, t := '') order by pos) as o from cv group by all)",
    "nf as (select filename, min(pr) as pr, arg_min(o, pr) as o from ni group by filename)",
    f"""alr as (select ct.filename, ct.profile, ct.unit_id, ct.condition, 'X' as axis, 'categorical' as kind, extraction_source as src, ba_final_status as st, content as disp, {_TEXTS('content', _LABEL)} as o, eligible from ct
        union all select fr.filename, fr.profile, fr.unit_id, fr.condition, upper(fr.axis), kind, case when kind = 'temporal' then 'AUTO_OR_MANUAL' else case pr when 1 then 'MANUAL_ADJUDICATED' when 2 then 'AUTO_VALIDATED' when 3 then 'AUTO_FALLBACK' else 'NONE' end end,
          case when kind = 'temporal' then coalesce(manual_result, '') when pr is null then 'UNEVALUABLE' else 'OBSERVED_COMPLETE' end,
          case when kind = 'temporal' then array_to_string([trim(p) for p in string_split(coalesce(years, ''), '|') if trim(p) <> ''], ' | ') else case pr when 1 then trim(fr.manual) when 2 then coalesce(fr.selected, '') when 3 then trim(fr.selected) else '' end end,
          case when kind = 'temporal' then {_TEXTS('years')} else coalesce(nf.o, []) end, '' from fr left join nf on nf.filename = fr.filename where kind in ('temporal', 'numeric'))""",
    f"""jn as (select alr.*, scope, status, display, canonical, x_order, case when kind = 'numeric' then [struct_pack(typ := case when trim(p) like '%\\%' escape '\\' then 'PCT' else 'NUM' end, x := cast(rtrim(trim(p), '%') as double), t := '') for p in string_split(canonical, '|') if trim(p) <> ''] else {_TEXTS('canonical')} end as e,
        case when kind = 'categorical' then case when scope <> 'EXHAUSTIVE' then 'NOT_EVALUATED' when starts_with(status, 'REVIEW_') then 'UNEVALUABLE_SPEC_REVIEW' when eligible <> 'YES' then 'UNEVALUABLE' end
          when scope in ('NOT_SPECIFIED', 'EXAMPLES_ONLY') then 'NOT_EVALUATED' when starts_with(status, 'REVIEW_') then 'UNEVALUABLE_SPEC_REVIEW' when kind = 'temporal' and status <> 'READY_TEMPORAL' then 'NOT_EVALUATED'
          when kind = 'numeric' and not starts_with(status, 'READY_') then 'NOT_EVALUATED' when len(o) = 0 then 'UNEVALUABLE' end as closed from alr join spc on spc.unit_id = alr.unit_id and spc.axis = alr.axis)""",
    f"df as (select *, closed is null as compared, closed is null or closed = 'UNEVALUABLE' as reached, case when closed is null then {_MORE('e', 'o')} else [] end as mi, case when closed is null then {_MORE('o', 'e')} else [] end as xi from jn)",
    """rp as (select *, coalesce(closed, case when len(mi) = 0 and len(xi) = 0 then 'NORMALIZED_EQUIVALENT' when len(xi) = 0 then 'NONCONFORMING_MISSING' when len(mi) = 0 then 'NONCONFORMING_EXTRA' else 'NONCONFORMING_VALUE' end) as bb_detailed_status,
        case when closed is null then 'YES' else 'NO' end as denominator_eligible from df)""",
)


@query(with_(*REPORT, select=f"""select filename, profile, unit_id, condition, axis, kind, case when kind = 'categorical' then 'BA_CAT_PRODUCTION' else 'BA_V7_PRODUCTION' end as source_batch,
   scope as f_tick_list_scope, status as f_target_status, display as f_expected_display, canonical as f_expected_canonical, case when axis = 'X' then x_order else 'NOT_SPECIFIED' end as f_order_required,
   case when kind = 'categorical' or reached then src else '' end as ba_source, case when kind = 'categorical' or reached then st else '' end as ba_final_status, case when kind = 'categorical' or reached then disp else '' end as observed_display,
   case when case when kind = 'categorical' then compared else reached end then {_SHOW('o')} else '' end as observed_canonical, bb_detailed_status,
   case when bb_detailed_status = 'NORMALIZED_EQUIVALENT' then 'CONFORMING' when starts_with(bb_detailed_status, 'NONCONFORMING') then 'NONCONFORMING' when bb_detailed_status = 'NOT_EVALUATED' then 'NOT_SPECIFIED' else 'UNEVALUABLE' end as bb_collapsed_status,
   {_SHOW('mi')} as missing_items, {_SHOW('xi')} as extra_items, {REASON_SQL} as bb_reason, denominator_eligible, 'B_B_NORMALIZATION_V1' as normalization_version from rp"""))
def g01_bb_compare(spark, sf):
    """Specification and the three observation tables are read apart and meet only in the comparison."""
    spec = SPEC_X.spark(spark, sf).unionByName(SPEC_Y.spark(spark, sf))
    return TC.tick_report(spec, CAT_ROWS.spark(spark, sf), FINAL_ROWS.spark(spark, sf), AXIS_READ.spark(spark, sf))
