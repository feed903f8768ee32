"""Row rules over image facts (names, flags, statuses, formats)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import status as S
from gaugeframe.functions import text as T
from gaugeframe.functions.color import hex_channels
from gaugeframe.functions.numbers import rint_round
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import FILE_NAMES, TOKENS, Derived, file_names, r6, table, tokens, with_

NAME_RX = S.IMAGE_NAME


def one(src: Derived, body: str) -> str:
    return with_(src.cte, select=f"select {body} from {src.name}")


# ------------------------------------------------------------------------------------------- names
@query(
    with_(
        FILE_NAMES,
        "p as (select *, regexp_matches(filename, '" + NAME_RX + "') as ok from files)",
        select=f"""select filename, o_orderkey,
          case when ok then upper(regexp_extract(filename, '{NAME_RX}', 1)) end as profile,
          case when ok then upper(substr(filename, 1, 1)) end as technique,
          case when ok then upper(substr(filename, 2, 1)) end as task,
          case when ok then cast(regexp_extract(filename, '{NAME_RX}', 2) as integer) end as unit_number,
          case when ok then cast(regexp_extract(filename, '{NAME_RX}', 3) as integer) end as repeat,
          case when ok then upper(substr(filename, 1, 6)) end as unit_id,
          case when ok then upper(substr(filename, 1, 10)) end as image_id,
          case when ok then 1 else 0 end as name_valid from p""",
    )
)
def b01_parse_image_name(spark, sf):
    df = file_names(spark, sf)
    return df.select("o_orderkey", "filename", *[c.alias(n) for n, c in S.parse_image_name(F.col("filename")).items()])


_in = "({})".format
TRUE_SQL = _in(", ".join(f"'{w}'" for w in T.TRUE_WORDS))
FALSE_SQL = _in(", ".join(f"'{w}'" for w in T.FALSE_WORDS))


def tr(c: str) -> str:
    return f"coalesce(lower(trim(cast({c} as varchar))), '') in {TRUE_SQL}"


def fa(c: str) -> str:
    return f"coalesce(lower(trim(cast({c} as varchar))), '') in {FALSE_SQL}"


@query(with_(TOKENS, select=f"select ({tr('w')}) as is_true, ({fa('w')}) as is_false, count(*) as n_words, cast(sum(n) as bigint) as n_tokens from token group by all"))
def b02_truthy_falsey(spark, sf):
    t = tokens(spark, sf).withColumns({"is_true": T.truthy(F.col("w")), "is_false": T.falsey(F.col("w"))})
    return t.groupBy("is_true", "is_false").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"))


@query(r"select page_id, list_extract(string_split_regex(trim(url), '[/\\]'), -1) as base from pages")
def b03_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.basename(F.col("url")).alias("base"))


# ---------------------------------------------------------------------------------------- statuses
MARKS = Derived("m", "orders", {
    "filename": "o_orderkey",
    "raw": "case o_orderkey % 4 when 0 then 'MARK_PRESENT' when 1 then 'mark_absent' when 2 then '' end",
    "present": "case when o_orderkey % 3 = 0 then '1' when o_orderkey % 3 = 1 then '1.0' else 'sim' end",
    "absent": "case when o_orderkey % 17 = 0 then 'YES' when o_orderkey % 5 = 0 then 'x' end",
})
MARK_SQL = f"""case when upper(trim(coalesce(raw, ''))) like '%ABSENT%' or {tr('absent')} then 'NONCONFORMING'
  when upper(trim(coalesce(raw, ''))) like '%PRESENT%' or {tr('present')} then 'CONFORMING' else 'UNEVALUABLE' end"""


@query(one(MARKS, f"filename, {MARK_SQL} as status"))
def b04_map_mark_status(spark, sf):
    m = MARKS.spark(spark, sf)
    return m.select("filename", S.mark_status(F.col("raw"), F.col("present"), F.col("absent")).alias("status"))


AXES = Derived("a", "orders", {
    "filename": "o_orderkey",
    "raw": "case o_orderkey % 8 when 0 then 'BOTH_PRESENT' when 1 then 'Not_Evaluable' when 2 then 'X_ONLY' when 3 then '' when 4 then 'UNEVALUABLE' when 5 then ' both_present ' when 6 then 'NONE' end",
    "xe": "case when o_orderkey % 19 <> 0 then '1' else '0' end",
    "ye": "case when o_orderkey % 3 <> 0 then 'true' else '' end",
    "xp": "case when o_orderkey % 7 <> 0 then 's' else 'n' end",
    "yp": "case when o_orderkey % 11 <> 0 then 'ok' end",
})


@query(one(AXES, f"""filename, case when upper(trim(coalesce(raw,''))) = 'BOTH_PRESENT' then 'CONFORMING'
  when upper(trim(coalesce(raw,''))) in ('UNEVALUABLE','NOT_EVALUABLE') then 'UNEVALUABLE'
  when {tr('xe')} and {tr('ye')} then case when {tr('xp')} and {tr('yp')} then 'CONFORMING' else 'NONCONFORMING' end
  when trim(coalesce(raw,'')) <> '' then 'NONCONFORMING' else 'UNEVALUABLE' end as status"""))
def b05_map_axis_status(spark, sf):
    a = AXES.spark(spark, sf)
    return a.select("filename", S.axis_status(*[F.col(c) for c in ("raw", "xe", "ye", "xp", "yp")]).alias("status"))


COLOR_ROWS = Derived("c", "orders", {
    "filename": "o_orderkey",
    "raw": "case o_orderkey % 3 when 0 then 'Match' when 1 then 'EXTRA_COLOR' end",
    "evaluable": "case when o_orderkey % 13 <> 0 then '1' else '0' end",
    "no_mark": "case when o_orderkey % 17 = 0 then '1' else '0' end",
    "strict": "case when o_orderkey % 5 = 0 then '1' end",
})


@query(one(COLOR_ROWS, f"""filename, case when {tr('no_mark')} or not ({tr('evaluable')}) then 'UNEVALUABLE'
  when {tr('strict')} or upper(trim(coalesce(raw,''))) = 'MATCH' then 'CONFORMING' else 'NONCONFORMING' end as status"""))
def b06_map_color_status(spark, sf):
    c = COLOR_ROWS.spark(spark, sf)
    return c.select("filename", S.color_dimension_status(*[F.col(x) for x in ("raw", "evaluable", "no_mark", "strict")]).alias("status"))


REVIEWS = Derived("r", "orders", {
    "filename": "o_orderkey",
    "needs": "case when o_orderstatus = 'P' then '1' else '0' end",
    "both_auto": "case when o_orderkey % 7 <> 0 then 'true' else 'false' end",
    "mx": "case o_orderkey % 5 when 0 then 'sim' when 1 then 'nao' when 2 then '' when 3 then 'maybe' end",
    "my": "case o_orderkey % 4 when 0 then 'Y' when 1 then 'N' when 2 then '' end",
    "mc": "case o_orderkey % 9 when 0 then 'BOTH_PRESENT' when 1 then 'x_only' when 2 then 'UNEVALUABLE' when 3 then 'OK' when 4 then 'ABSENT' when 5 then 'unsure' end",
})
MANUAL_SQL = f"""case when {tr('mx')} and {tr('my')} then 'CONFORMING'
  when ({tr('mx')} or {fa('mx')}) and ({tr('my')} or {fa('my')}) then 'NONCONFORMING'
  when upper(trim(coalesce(mc,''))) in ('BOTH_PRESENT','CONFORMING','OK','PRESENT') then 'CONFORMING'
  when upper(trim(coalesce(mc,''))) in ('X_ONLY','Y_ONLY','NONE','ABSENT','NONCONFORMING') then 'NONCONFORMING'
  when upper(trim(coalesce(mc,''))) in ('UNEVALUABLE','NOT_EVALUABLE') then 'UNEVALUABLE' end"""


@query(one(REVIEWS, f"filename, {MANUAL_SQL} as status"))
def b07_manual_ticklabel_final(spark, sf):
    return REVIEWS.spark(spark, sf).select("filename", S.manual_presence(F.col("mx"), F.col("my"), F.col("mc")).alias("status"))


@query(with_(REVIEWS.cte, f"d as (select *, {MANUAL_SQL} as manual from r)", select=f"""select filename,
  case when {tr('needs')} then coalesce(manual, 'PENDING_FINAL_ADJUDICATION') when {tr('both_auto')} then 'CONFORMING'
       else coalesce(manual, 'PENDING_FINAL_ADJUDICATION') end as status,
  case when {tr('needs')} then case when manual is not null then 'MANUAL_REVIEW' else 'REVIEW_REQUIRED' end
       when {tr('both_auto')} then 'AUTO_FROZEN' when manual is not null then 'MANUAL_REVIEW' else 'AUTO_EXCEPTION' end as source from d"""))
def b08_map_ticklabel_presence(spark, sf):
    manual = S.manual_presence(F.col("mx"), F.col("my"), F.col("mc"))
    return REVIEWS.spark(spark, sf).select("filename", S.presence_decision(F.col("needs"), F.col("both_auto"), manual).alias("d")).select("filename", "d.*")


PAIRS = Derived("p", "orders", {
    "filename": "o_orderkey",
    "xe": "case when o_orderkey % 19 <> 0 then 1 else 0 end",
    "ye": "case when o_orderkey % 23 <> 0 then 1 end",
    "x": "case when o_orderkey % 7 <> 0 then 1 else 0 end",
    "y": "case when o_orderkey % 11 <> 0 then 1 end",
})
PAIR_SQL = """case when coalesce(xe,0) <> 1 or coalesce(ye,0) <> 1 then 'UNEVALUABLE' when x = 1 and y = 1 then 'BOTH_PRESENT'
  when x = 1 then 'X_ONLY' when y = 1 then 'Y_ONLY' else 'NONE' end"""


@query(with_(PAIRS.cte, f"d as (select *, {PAIR_SQL} as axes_status from p)", select="""select filename, axes_status,
  case when axes_status <> 'UNEVALUABLE' then case when x = 1 then 1 else 0 end end as x_present,
  case when axes_status <> 'UNEVALUABLE' then case when y = 1 then 1 else 0 end end as y_present,
  case when axes_status <> 'UNEVALUABLE' then case when x = 1 and y = 1 then 1 else 0 end end as both_present from d"""))
def b09_axes_status(spark, sf):
    d = PAIRS.spark(spark, sf).withColumn("axes_status", S.pair_presence(*[F.col(c) for c in ("xe", "ye", "x", "y")]))
    seen = F.col("axes_status") != S.U
    x, y = F.coalesce(F.col("x"), F.lit(0)), F.coalesce(F.col("y"), F.lit(0))
    return d.select("filename", "axes_status", F.when(seen, x).alias("x_present"), F.when(seen, y).alias("y_present"), F.when(seen, x * y).alias("both_present"))


@query(with_(PAIRS.cte, f"d as (select *, {PAIR_SQL} as presence_status_auto from p)", select="""select filename, presence_status_auto,
  case when presence_status_auto = 'BOTH_PRESENT' then 1 else 0 end as both_present_auto,
  case when presence_status_auto <> 'BOTH_PRESENT' then 1 else 0 end as needs_visual_review from d"""))
def b10_ticklabel_status(spark, sf):
    d = PAIRS.spark(spark, sf).select("filename", S.pair_presence(*[F.col(c) for c in ("xe", "ye", "x", "y")]).alias("presence_status_auto"))
    both = (F.col("presence_status_auto") == "BOTH_PRESENT").cast("int")
    return d.withColumns({"both_present_auto": both, "needs_visual_review": 1 - both})


# -------------------------------------------------------------------------------- evidence, classes
EVIDENCE = Derived("e", "orders", {
    "filename": "o_orderkey",
    "evidence": "concat('MAX_H_FRAC=', cast(o_orderkey * 31 % 200 as string), 'e-3;XBIN_SUPPORT=', case when o_orderkey % 9 = 0 then 'bad' else concat('0.', cast(o_orderkey * 17 % 90 + 10 as string)) end, ';note;N_MARKERS=', cast(o_orderkey % 5 as string), ';XDISP=0.0', cast(o_orderkey * 13 % 9 as string), case when o_orderkey % 4 = 0 then ';N_MARKERS=1' else '' end)",
})
EV_SQL = """ev as (
  select filename, max(case when k = 'MAX_H_FRAC' then v end) as h, max(case when k = 'XBIN_SUPPORT' then v end) as s,
         max(case when k = 'N_MARKERS' then v end) as m, max(case when k = 'XDISP' then v end) as xd, max(case when k = 'YDISP' then v end) as yd
  from (select filename, k, arg_max(v, pos) as v from (
          select filename, pos, split_part(part, '=', 1) as k, try_cast(substr(part, strpos(part, '=') + 1) as double) as v
          from (select filename, unnest(string_split(evidence, ';')) as part, generate_subscripts(string_split(evidence, ';'), 1) as pos from e)
          where part like '%=%') where v is not null group by filename, k)
  group by filename)"""
EV_COLS = "coalesce(h,0.0) as height, coalesce(s,0.0) as support, coalesce(m,0.0) as markers, coalesce(xd,0.0) as xdisp, coalesce(yd,0.0) as ydisp"
EV_KEYS = {"height": "MAX_H_FRAC", "support": "XBIN_SUPPORT", "markers": "N_MARKERS", "xdisp": "XDISP", "ydisp": "YDISP"}


def evidence_columns(spark, sf):
    return EVIDENCE.spark(spark, sf).select("filename", *[S.evidence_value(F.col("evidence"), k).alias(n) for n, k in EV_KEYS.items()])


@query(with_(EVIDENCE.cte, EV_SQL, select=f"select filename, {EV_COLS} from ev"))
def b11_parse_evidence(spark, sf):
    e = EVIDENCE.spark(spark, sf).withColumn("m", S.evidence_map(F.col("evidence")))
    return e.select("filename", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)).alias(n) for n, k in EV_KEYS.items()])


RULE_SQL = """case when height >= 0.10 then 'BAR' when support >= 0.50 then 'LINE'
  when floor(markers) >= 2 and (xdisp >= 0.03 or ydisp >= 0.03) then 'SCATTER' else 'OTHER' end"""
REASON_SQL = """case when height >= 0.10 then 'BAR_MAX_H_FRAC>=0.10' when support >= 0.50 then 'LINE_XBIN_SUPPORT>=0.50'
  when floor(markers) >= 2 and (xdisp >= 0.03 or ydisp >= 0.03) then 'SCATTER_MARKERS_AND_DISPERSION' else 'NO_EXCLUSIVE_RULE' end"""


@query(with_(EVIDENCE.cte, EV_SQL, f"v as (select filename, {EV_COLS} from ev)", select=f"select filename, {RULE_SQL} as observed, {REASON_SQL} as reason from v"))
def b12_classify_exclusive(spark, sf):
    e = evidence_columns(spark, sf)
    return e.select("filename", S.exclusive_class(*[F.col(n) for n in EV_KEYS]).alias("c")).select("filename", "c.*")


@query(f"""select bar, line, scatter, label, count(*) as n, count(*) filter (where label = 'BAR_ONLY') as exact_expected_only
  from (select *, case when bar + line + scatter = 0 then 'NONE_OR_OTHER'
          when bar + line + scatter = 1 then case when bar = 1 then 'BAR_ONLY' when line = 1 then 'LINE_ONLY' else 'SCATTER_ONLY' end
          else rtrim(case when bar = 1 then 'BAR_' else '' end || case when line = 1 then 'LINE_' else '' end || case when scatter = 1 then 'SCATTER' else '' end, '_') end as label
        from (select case when l_quantity > 25 then 1 else 0 end as bar, case when l_discount > 0.05 then 1 else 0 end as line,
                     case when l_tax > 0.04 then 1 else 0 end as scatter from lineitem)) group by all""")
def b13_signature_label(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("cast(l_quantity > 25 as int) bar", "cast(l_discount > 0.05D as int) line", "cast(l_tax > 0.04D as int) scatter")
    counts = li.groupBy("bar", "line", "scatter").agg(F.count(F.lit(1)).alias("n"))
    label = S.signature(F.col("bar"), F.col("line"), F.col("scatter"))
    return counts.withColumn("label", label).withColumn("exact_expected_only", F.when(F.col("label") == "BAR_ONLY", F.col("n")).otherwise(F.lit(0).cast("bigint")))


TECH = "case filename % 3 when 0 then 'B' when 1 then 'L' else 'S' end"


@query(with_(EVIDENCE.cte, EV_SQL, f"v as (select filename, {TECH} as expected, {EV_COLS} from ev)",
             "h as (select *, list_filter([case when expected <> 'B' and height >= 0.10 then 'BAR' end, case when expected <> 'L' and support >= 0.5 then 'LINE' end, "
             "case when expected <> 'S' and floor(markers) >= 2 and xdisp >= 0.03 and ydisp >= 0.03 then 'SCATTER' end], lambda x: x is not null) as hits from v)",
             select="select filename, case len(hits) when 0 then 'OTHER_OR_EMPTY' when 1 then hits[1] else 'MIXED_CANDIDATE:' || array_to_string(hits, '+') end as candidate from h"))
def b14_alternate_candidates(spark, sf):
    e = evidence_columns(spark, sf).withColumn("expected", F.expr(TECH))
    return e.select("filename", S.alternate_class(F.col("expected"), *[F.col(n) for n in EV_KEYS]).alias("candidate"))


MANUALS = Derived("m", "orders", {
    "filename": "o_orderkey",
    "manual": "case o_orderkey % 8 when 0 then 'bar' when 1 then ' LINE ' when 2 then 'Scatter' when 3 then 'OTHER' when 4 then 'EMPTY_NO_DATA' when 5 then 'UNCERTAIN' when 6 then 'pie' end",
    "observed": "case o_orderkey % 5 when 0 then 'BAR' when 1 then 'LINE' when 2 then 'SCATTER' when 3 then 'OTHER' else 'BAR' end",
})
FOUR_SQL = """case when upper(trim(coalesce(manual,''))) in ('BAR','LINE','SCATTER','OTHER') then upper(trim(manual))
  when upper(trim(coalesce(manual,''))) = 'EMPTY_NO_DATA' then 'OTHER' else 'UNEVALUABLE' end"""


@query(one(MANUALS, f"filename, {FOUR_SQL} as four_class"))
def b15_manual_to_four_class(spark, sf):
    return MANUALS.spark(spark, sf).select("filename", S.four_class(F.col("manual")).alias("four_class"))


@query(with_(FILE_NAMES, f"p as (select upper(substr(filename,1,2)) as profile, upper(substr(filename,1,6)) as unit_id, o_orderkey from files where regexp_matches(filename, '{NAME_RX}'))",
             select="""select o_orderkey, profile, unit_id, case substr(profile,1,1) when 'B' then 'BAR' when 'L' then 'LINE' else 'SCATTER' end as expected
               from p where unit_id not in ('SC_024','SC_037')"""))
def b16_expected_by_profile(spark, sf):
    names = file_names(spark, sf)
    p = names.select("o_orderkey", *[c.alias(n) for n, c in S.parse_image_name(F.col("filename")).items() if n in ("profile", "unit_id", "name_valid")])
    kept = p.where((F.col("name_valid") == 1) & ~F.col("unit_id").isin(S.SPEC_CONFLICT_UNITS))
    return kept.select("o_orderkey", "profile", "unit_id", S.expected_class(F.col("profile")).alias("expected"))


LAYERS = Derived("l", "orders", {
    "filename": "o_orderkey",
    "seg": "case when o_orderkey % 3 = 0 then 1 else 0 end",
    "grp": "o_orderkey % 5",
    "span": "cast(o_orderkey * 7 % 50 as double) / 100",
    "bins": "o_orderkey * 11 % 30",
    "extent": "cast(o_orderkey * 13 % 60 as double) / 100",
    "share": "cast(o_orderkey * 17 % 40 as double) / 100",
    "near": "case when o_orderkey % 29 = 0 then cast('NaN' as double) when o_orderkey % 31 <> 0 then cast(o_orderkey * 19 % 60 as double) / 100 end",
})


@query(with_(LAYERS.cte, """d as (select *, coalesce(not isnan(near) and near <= 0.45, false) as usable from l)""",
             """f as (select filename, usable, seg = 1 as s, usable and grp >= 2 and span >= 0.12 as d, usable and bins >= 8 and extent >= 0.28 and share >= 0.16 as c from d)""",
             select="""select filename, case when usable and (s or d or c) then 1 else 0 end as present,
               coalesce(nullif(concat_ws('+', case when s then 'SEG' end, case when d then 'DISCRETE' end, case when c then 'CONGESTED' end), ''), 'NONE') as evidence from f"""))
def b17_presence_from_evidence(spark, sf):
    args = [F.col(c) for c in ("seg", "grp", "span", "bins", "extent", "share", "near")]
    return LAYERS.spark(spark, sf).select("filename", S.layer_presence(*args).alias("p")).select("filename", "p.*")


SUPPORT = Derived("s", "orders", {
    "filename": "o_orderkey",
    "kind": "case o_orderkey % 3 when 0 then 'categorical' when 1 then 'temporal' else 'numeric' end",
    "share": "cast(o_orderkey * 7 % 101 as double) / 100",
    "boxes": "o_orderkey % 4",
    "has_text": "o_orderkey % 5 <> 0",
    "band": "o_orderkey % 2 = 0",
    "found": "o_orderkey % 7 < 4",
    "mono": "case o_orderkey % 11 when 0 then 0 when 1 then 1 end",
    "scale": "case o_orderkey % 13 when 0 then 'AMBIGUOUS' else 'CONFIDENT' end",
    "selection": "case o_orderkey % 17 when 0 then 'PARTIAL_UNREADABLE' when 1 then 'SELECTED_BY_COHERENCE' when 2 then 'AMBIGUOUS' else 'COHERENT_DIRECT' end",
})


@query(with_(SUPPORT.cte, """d as (select *, case when kind = 'categorical' then case when has_text and band then 'HYBRID_EVIDENCE' when has_text then 'INDIVIDUAL_ONLY' when band then 'BAND_ONLY' else 'FAILED' end
      else case when boxes > 0 and share >= 0.5 then 'INDIVIDUAL' when band then 'BAND_FALLBACK' when has_text then 'INDIVIDUAL_PARTIAL' else 'FAILED' end end as mode from s)""",
             select="""select filename, mode, case when mode = 'FAILED' then 'FAIL_CANDIDATE'
      when kind = 'categorical' then case when has_text and band and found then 'MULTI_EVIDENCE' else 'SINGLE_EVIDENCE' end
      when kind = 'temporal' and share >= 0.75 and (mono is null or mono = 1) then 'STRONG_CANDIDATE'
      when kind = 'numeric' and share >= 0.75 and scale <> 'AMBIGUOUS' and selection in ('COHERENT_DIRECT','SELECTED_BY_COHERENCE') then 'STRONG_CANDIDATE'
      when has_text or band then 'PARTIAL_CANDIDATE' else 'FAIL_CANDIDATE' end as support from d"""))
def b18_extraction_mode_support(spark, sf):
    k, share, text, band = F.col("kind"), F.col("share"), F.col("has_text"), F.col("band")
    d = SUPPORT.spark(spark, sf).withColumn("mode", S.extraction_mode(k, share, F.col("boxes"), text, band))
    sup = S.extraction_support(k, F.col("mode"), share, text, band, F.col("found"), F.col("mono"), F.col("scale"), F.col("selection"))
    return d.select("filename", "mode", sup.alias("support"))


VALUES = Derived("v", "lineitem", {
    "l_orderkey": "l_orderkey",
    "own": "case when l_linenumber <> 3 then l_quantity end",
    "factor": "case l_returnflag when 'A' then cast(1000 as double) when 'N' then cast(1 as double) else cast(1000000 as double) end",
    "scale_status": "case when l_linestatus = 'F' then 'AMBIGUOUS' else 'CONFIDENT' end",
    "scale_factor": "cast(10 as double)",
})


@query(with_(VALUES.cte, select="select l_orderkey, case when scale_status <> 'AMBIGUOUS' then own * factor * scale_factor end as effective_value from v"))
def b19_effective_value(spark, sf):
    v = VALUES.spark(spark, sf)
    return v.select("l_orderkey", F.when(F.col("scale_status") != "AMBIGUOUS", F.col("own") * F.col("factor") * F.col("scale_factor")).alias("effective_value"))


PRIORITY = "support in ('PARTIAL_CANDIDATE','FAIL_CANDIDATE') or selection in ('SELECTED_BY_COHERENCE','PARTIAL_UNREADABLE','AMBIGUOUS','INSUFFICIENT')"
SUP_ROWS = Derived("s", "orders", {
    "filename": "o_orderkey",
    "support": "case o_orderkey % 4 when 0 then 'PARTIAL_CANDIDATE' when 1 then 'FAIL_CANDIDATE' else 'STRONG_CANDIDATE' end",
    "selection": "case o_orderkey % 7 when 0 then 'SELECTED_BY_COHERENCE' when 1 then 'PARTIAL_UNREADABLE' when 2 then 'AMBIGUOUS' when 3 then 'INSUFFICIENT' else 'COHERENT_DIRECT' end",
    "kind": "case o_orderkey % 3 when 0 then 'categorical' when 1 then 'temporal' else 'numeric' end",
    "orientation": "case o_orderkey % 5 when 0 then 'AMBIGUOUS' else 'VERTICAL' end",
    "status": "case o_orderkey % 6 when 0 then 'CATEGORICAL_PARTIAL' else 'CATEGORICAL_COMPLETE' end",
    "bbox_source": "case o_orderkey % 11 when 0 then 'FALLBACK_GEOMETRIC' else 'DETECTED' end",
    "scale_status": "case o_orderkey % 13 when 0 then 'AMBIGUOUS' else 'CONFIDENT' end",
})


@query(with_(SUP_ROWS.cte, select=f"select filename, support, selection from s where {PRIORITY}"))
def b20_priority_filter_axes(spark, sf):
    s = SUP_ROWS.spark(spark, sf)
    weak = F.col("support").isin("PARTIAL_CANDIDATE", "FAIL_CANDIDATE")
    unsure = F.col("selection").isin("SELECTED_BY_COHERENCE", "PARTIAL_UNREADABLE", "AMBIGUOUS", "INSUFFICIENT")
    return s.where(weak | unsure).select("filename", "support", "selection")


@query(with_(SUP_ROWS.cte, select="select filename, orientation, status, bbox_source from s where orientation = 'AMBIGUOUS' or status <> 'CATEGORICAL_COMPLETE' or bbox_source = 'FALLBACK_GEOMETRIC'"))
def b21_priority_filter_cat(spark, sf):
    s = SUP_ROWS.spark(spark, sf)
    odd = (F.col("orientation") == "AMBIGUOUS") | (F.col("status") != "CATEGORICAL_COMPLETE") | (F.col("bbox_source") == "FALLBACK_GEOMETRIC")
    return s.where(odd).select("filename", "orientation", "status", "bbox_source")


@query(with_(SUP_ROWS.cte, select="select filename, kind, support, cast(null as varchar) as manual_result, cast(null as varchar) as manual_notes from s"))
def b22_audit_projection(spark, sf):
    from gaugeframe.operators.review import audit_projection

    return audit_projection(SUP_ROWS.spark(spark, sf), ["filename", "kind", "axis", "support"], ["manual_result", "manual_notes"])


@query(with_(SUP_ROWS.cte, select="select filename, scale_status, selection from s where kind = 'numeric'"))
def b23_scale_diagnostic(spark, sf):
    return SUP_ROWS.spark(spark, sf).where("kind = 'numeric'").select("filename", "scale_status", "selection")


LABEL_SQL = r"trim(regexp_replace(regexp_replace(translate(upper(strip_accents(replace(w, 'ß', 'ss'))), '–—', '--'), '[^A-Z0-9/%+\-.,() ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(with_(TOKENS,
             r"p as (select *, w || case when n % 2 = 0 then ' c' else ' x1' end as raw from token)",
             f"q as (select raw, n, {LABEL_SQL.replace('(w,', '(raw,')} as label from p)",
             r"""r as (select *, list_filter(string_split(label, ' '), lambda x: regexp_matches(x, '[A-Z]')) as words from q)""",
             select=r"""select raw, n, case when label = '' then ''
               when regexp_matches(raw, '^[-_/.,;:]') and len(regexp_replace(raw, '[^A-Za-z]', '', 'g')) >= 6 then 'LEADING_EDGE_PUNCTUATION'
               when len(words) >= 2 and len(words[-1]) = 1 and len(regexp_replace(label, '[^A-Z]', '', 'g')) >= 8 then 'TRAILING_SINGLE_LETTER' else '' end as reason from r"""))
def b24_suspicious_text(spark, sf):
    t = tokens(spark, sf).withColumn("raw", F.concat(F.col("w"), F.when(F.col("n") % 2 == 0, " c").otherwise(" x1")))
    return t.select("raw", "n", T.suspicious_text(F.col("raw")).alias("reason"))


# ------------------------------------------------------------------------------------------ colour
COLOR_IMG = Derived("c", "orders", {
    "filename": "o_orderkey",
    "extraction_status": "case when o_orderkey % 17 = 0 then 'no_mark' else 'OK' end",
    "dmax": "case when o_orderkey % 5 <> 0 then cast(o_orderkey * 37 % 400 as double) / 100 end",
    "n_missing": "case o_orderkey % 7 when 0 then '1' when 1 then 'x' else '0' end",
    "n_semantic": "case when o_orderkey % 11 = 0 then 2 else 0 end",
    "n_near": "case when o_orderkey % 13 = 0 then 1 else 0 end",
    "variation": "case when o_orderkey % 3 = 0 then '1' end",
    "n_overlap": "case when o_orderkey % 19 = 0 then 1 else 0 end",
})
FLAG_SQL = """fl as (select *, case when upper(extraction_status) <> 'NO_MARK' then 1 else 0 end as color_evaluable,
   case when dmax is not null then case when dmax <= 2.0 then 1 else 0 end end as color_match,
   case when dmax > 2.0 then 1 else 0 end as color_deviation, case when try_cast(n_missing as double) > 0 then 1 else 0 end as missing_color,
   case when upper(extraction_status) = 'NO_MARK' then 1 else 0 end as no_mark, case when n_semantic > 0 then 1 else 0 end as semantic_extra,
   case when n_near > 0 then 1 else 0 end as near_duplicate, case when try_cast(variation as double) > 0 then 1 else 0 end as internal_variation,
   case when n_overlap > 0 then 1 else 0 end as overlap_derived from c)"""
FLAG_NAMES = ["color_evaluable", "color_match", "color_deviation", "missing_color", "no_mark", "semantic_extra", "near_duplicate", "internal_variation", "overlap_derived"]
STATUS_SQL = """case when no_mark = 1 then 'NO_MARK' else coalesce(nullif(concat_ws('+', case when missing_color = 1 then 'MISSING_COLOR' end, case when semantic_extra = 1 then 'EXTRA_COLOR' end,
   case when internal_variation = 1 then 'INTERNAL_VARIATION' end, case when color_deviation = 1 then 'COLOR_DEVIATION' end), ''), 'MATCH') end"""


def color_flag_rows(spark, sf):
    from gaugeframe.operators.color_rollup import color_flags

    return color_flags(COLOR_IMG.spark(spark, sf))


@query(with_(COLOR_IMG.cte, FLAG_SQL, select="select filename, " + ", ".join(FLAG_NAMES) + " from fl"))
def b25_color_flags(spark, sf):
    return color_flag_rows(spark, sf).select("filename", *FLAG_NAMES)


@query(with_(COLOR_IMG.cte, FLAG_SQL, f"st as (select filename, {STATUS_SQL} as color_status from fl)", select="select filename, color_status, case when color_status = 'MATCH' then 1 else 0 end as strict_match from st"))
def b26_color_status(spark, sf):
    return color_flag_rows(spark, sf).select("filename", "color_status", "strict_match")


COUNTS = Derived("k", "orders", {"filename": "o_orderkey", "observed": "o_orderkey % 4", "expected": "1 + o_orderkey % 2", "extra": "case when o_orderkey % 4 > 1 + o_orderkey % 2 then 1 else 0 end", "missing": "case when o_orderkey % 4 < 1 + o_orderkey % 2 then 1 else 0 end"})


@query(one(COUNTS, "filename, case when observed = 0 then 'NO_MARK' when extra > 0 then 'EXTRA' when missing > 0 then 'MISSING' else 'EXACT' end as count_status, abs(observed - expected) as count_error_abs"))
def b27_count_status(spark, sf):
    k = COUNTS.spark(spark, sf)
    return k.select("filename", S.count_status(F.col("observed"), F.col("extra"), F.col("missing")).alias("count_status"), F.abs(F.col("observed") - F.col("expected")).alias("count_error_abs"))


FRAMES = Derived("f", "orders", {
    "filename": "o_orderkey",
    "w": "case when o_orderkey % 9 = 0 then 1000 else 1200 end",
    "h": "800",
    "left_px": "case when o_orderkey % 23 <> 0 then cast(80 + o_orderkey % 40 as double) end",
    "right_px": "cast(1100 + o_orderkey % 60 as double)",
    "top_px": "cast(80 + o_orderkey % 30 as double)",
    "bottom_px": "cast(650 + o_orderkey % 50 as double)",
})
NORM_SQL = "left_px / w as left_norm, right_px / w as right_norm, 1.0 - top_px / h as top_norm, 1.0 - bottom_px / h as bottom_norm"


def frame_norm(spark, sf):
    return FRAMES.spark(spark, sf).withColumns({
        "left_norm": F.col("left_px") / F.col("w"),
        "right_norm": F.col("right_px") / F.col("w"),
        "top_norm": 1.0 - F.col("top_px") / F.col("h"),
        "bottom_norm": 1.0 - F.col("bottom_px") / F.col("h"),
    })


ERR = {k: f"abs({k}_norm - {v})" for k, v in S.TARGET_FRAME.items()}


@query(with_(FRAMES.cte, f"n as (select filename, {NORM_SQL} from f)", "e as (select filename, " + ", ".join(f"{v} as {k}_error" for k, v in ERR.items()) + " from n)",
             "g as (select *, left_error + right_error + top_error + bottom_error as total from e)",
             select="select filename, " + ", ".join(f"case when total is not null then {r6(k + '_error')} end as {k}_error" for k in ERR) + f", {r6('total')} as layout_error_sum, {r6('total / 4')} as layout_error_mean from g"))
def b28_layout_error(spark, sf):
    n = frame_norm(spark, sf)
    err = {k: F.abs(F.col(f"{k}_norm") - F.lit(v)) for k, v in S.TARGET_FRAME.items()}
    total = err["left"] + err["right"] + err["top"] + err["bottom"]
    return n.select(
        "filename",
        *[F.when(total.isNotNull(), rint_round(e)).alias(f"{k}_error") for k, e in err.items()],
        rint_round(total).alias("layout_error_sum"),
        rint_round(total / 4).alias("layout_error_mean"),
    )


@query(with_(FRAMES.cte, f"n as (select *, {NORM_SQL} from f)", select=f"select filename, {r6('left_norm')} as left_norm, {r6('right_norm')} as right_norm, {r6('top_norm')} as top_norm, {r6('bottom_norm')} as bottom_norm, case when w = 1200 and h = 800 then 1 else 0 end as canvas_ok from n"))
def b29_plot_frame_norm(spark, sf):
    n = frame_norm(spark, sf)
    cols = ["left_norm", "right_norm", "top_norm", "bottom_norm"]
    return n.select("filename", *[rint_round(F.col(c)).alias(c) for c in cols], ((F.col("w") == S.CANVAS[0]) & (F.col("h") == S.CANVAS[1])).cast("int").alias("canvas_ok"))


@query("""select o_orderkey, case when v <= 500000 then 'AZUL' when v <= 300000000 then 'VERDE' when v <= 600000000 then 'ROXO' else 'VERMELHO' end as band
  from (select o_orderkey, o_totalprice * (1 + o_orderkey % 2000) as v from orders)""")
def b30_value_band(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice * (1 + o_orderkey % 2000) as v")
    return o.select("o_orderkey", S.value_band(F.col("v")).alias("band"))


_MK = "case when v >= 1000000 then cast(cast(floor(v / 1000000) as bigint) as varchar) || 'M' when v >= 1000 then cast(cast(floor(v / 1000) as bigint) as varchar) || 'K' else cast(cast(floor(v) as bigint) as varchar) end"


@query(f"""select o_orderkey, {_MK} as short, 'R$ ' || {_MK} as money,
    case when v >= 1000000 then cast(cast(floor(v / 1000000) as bigint) as varchar) || 'M' else '0' end as zero_below,
    case when v >= 1000000 then cast(cast(floor(v / 1000000) as bigint) as varchar) || 'M' when v = 0 then '0' else '' end as blank_below
  from (select o_orderkey, o_totalprice * (o_orderkey % 2000) / 100 as v from orders)""")
def b31_abbreviate_value(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice * (o_orderkey % 2000) / 100 as v")
    v = F.col("v")
    return o.select("o_orderkey", S.abbreviate(v).alias("short"), S.abbreviate(v, "R$ ").alias("money"), S.abbreviate(v, below_million="0").alias("zero_below"), S.abbreviate(v, below_million="").alias("blank_below"))


HEX_ROWS = Derived("x", "part", {"p_partkey": "p_partkey", "hex": "case when p_partkey % 50 = 0 then '#12' when p_partkey % 51 = 0 then 'nothex' else concat(case when p_partkey % 3 = 0 then '' else '#' end, upper(substr(md5(cast(p_partkey as string)), 1, 6))) end"})


@query(with_(HEX_ROWS.cte, "y as (select *, ltrim(trim(hex), '#') as d from x)", "z as (select *, regexp_full_match(d, '[0-9A-Fa-f]{6}') as ok from y)",
             select="select p_partkey, " + ", ".join(f"case when ok then cast(('0x' || substr(d, {i}, 2)) as integer) end as {n}" for n, i in (("r", 1), ("g", 3), ("b", 5))) + " from z"))
def b32_hex_decode(spark, sf):
    r, g, b = hex_channels(F.col("hex"))
    return HEX_ROWS.spark(spark, sf).select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


BOXES = Derived("b", "lineitem", {"l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_quantity": "l_quantity", "x0": "cast(l_partkey % 1100 as double)", "y0": "cast(l_suppkey % 700 as double)", "bw": "l_quantity", "bh": "cast(8 + l_linenumber as double)"})


@query(with_(BOXES.cte, select=f"select l_orderkey, l_partkey, l_quantity, {r6('(x0 + (x0 + bw) + (x0 + bw) + x0) / 4 / 1200')} as x_norm, {r6('(y0 + y0 + (y0 + bh) + (y0 + bh)) / 4 / 800')} as y_norm from b"))
def b33_token_center_norm(spark, sf):
    from gaugeframe.functions.geometry import polygon_center

    pt = F.expr("array(array(x0, y0), array(x0 + bw, y0), array(x0 + bw, y0 + bh), array(x0, y0 + bh))")
    b = BOXES.spark(spark, sf).select("l_orderkey", "l_partkey", "l_quantity", polygon_center(pt).alias("c"))
    return b.select("l_orderkey", "l_partkey", "l_quantity", rint_round(F.col("c.x") / 1200).alias("x_norm"), rint_round(F.col("c.y") / 800).alias("y_norm"))


COHERENCE = Derived("h", "orders", {
    "filename": "o_orderkey",
    "sel": "case o_orderkey % 5 when 0 then 'COHERENT_DIRECT' when 1 then 'PARTIAL_UNREADABLE' when 2 then 'AMBIGUOUS' when 3 then 'coherent_x' end",
    "nsel": "o_orderkey % 4",
    "band": "case when o_orderkey % 3 = 0 then 'FOUND' else 'NONE' end",
    "usable": "o_orderkey % 2",
    "ngrp": "o_orderkey * 7 % 5",
    "xc": "cast(o_orderkey * 11 % 101 as double) / 100", "xn": "cast(o_orderkey * 13 % 101 as double) / 100",
    "yc": "cast(o_orderkey * 17 % 101 as double) / 100", "yn": "cast(o_orderkey * 19 % 101 as double) / 100",
    "vg": "cast(o_orderkey * 23 % 101 as double) / 100", "hg": "cast(o_orderkey * 29 % 101 as double) / 100",
})
COH_SQL = "case when upper(coalesce(sel,'')) like 'COHERENT%' and nsel >= 2 then cast(1 as double) when upper(coalesce(sel,'')) like '%PARTIAL%' and nsel >= 2 then 0.65 when nsel >= 3 then 0.5 else 0.0 end"
BAND_SQL = "case when band = 'FOUND' and ngrp >= 2 then cast(1 as double) when usable = 1 and ngrp >= 1 then 0.75 when ngrp >= 2 then 0.6 else 0.0 end"


@query(one(COHERENCE, f"filename, {COH_SQL} as coherence, {BAND_SQL} as band_strength"))
def b34_numeric_coherence_band(spark, sf):
    return COHERENCE.spark(spark, sf).select(
        "filename",
        S.numeric_coherence(F.col("sel"), F.col("nsel")).alias("coherence"),
        S.band_strength(F.col("band"), F.col("usable"), F.col("ngrp")).alias("band_strength"),
    )


@query(with_(COHERENCE.cte, f"""k as (select filename, 0.38*xc + 0.32*greatest(yn, {COH_SQL}) + 0.15*({BAND_SQL}) + 0.15*vg as v, 0.43*yc + 0.37*xn + 0.2*hg as g from h)""",
             select=f"""select filename, {r6('v')} as vertical, {r6('g')} as horizontal,
               case when greatest(v, g) < 0.48 or abs(v - g) < 0.08 then 'AMBIGUOUS' when v > g then 'VERTICAL' else 'HORIZONTAL' end as orientation from k"""))
def b35_orientation_score(spark, sf):
    h = COHERENCE.spark(spark, sf)
    coh = S.numeric_coherence(F.col("sel"), F.col("nsel"))
    band = S.band_strength(F.col("band"), F.col("usable"), F.col("ngrp"))
    o = S.orientation(F.col("xc"), F.col("xn"), F.col("yc"), F.col("yn"), coh, band, F.col("vg"), F.col("hg"))
    return h.select("filename", o.alias("o")).select("filename", rint_round(F.col("o.vertical")).alias("vertical"), rint_round(F.col("o.horizontal")).alias("horizontal"), "o.orientation")


RIDGES = Derived("g", "orders", {
    "filename": "o_orderkey",
    "support": "cast(o_orderkey * 7 % 60 as double) / 100",
    "run": "case when o_orderkey % 3 <> 0 then cast(o_orderkey * 11 % 50 as double) / 100 end",
    "enc": "case o_orderkey % 7 when 0 then 'SOLID_CANDIDATE' when 1 then 'INSUFFICIENT_POINTS' when 2 then 'BRIGHTNESS_SCALE_CANDIDATE' when 3 then 'SATURATION_SCALE_CANDIDATE' when 4 then 'MIXED_SCALE_CANDIDATE' when 5 then 'CUSTOM' end",
})


@query(one(RIDGES, """filename, case when support >= 0.32 or run >= 0.28 then 1 else 0 end as present,
  case when enc = 'SOLID_CANDIDATE' then 'SOLID' when enc = 'INSUFFICIENT_POINTS' then 'INSUFFICIENT' when enc like '%SCALE_CANDIDATE' then 'VARIATION' else coalesce(enc, 'UNKNOWN') end as family_type"""))
def b36_ridge_family_type(spark, sf):
    return RIDGES.spark(spark, sf).select("filename", S.ridge_present(F.col("support"), F.col("run")).alias("present"), S.family_type(F.col("enc")).alias("family_type"))
