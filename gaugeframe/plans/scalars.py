"""Text, number and token scalars over the distinct tokens of all texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import geometry as G
from gaugeframe.functions import text as T
from gaugeframe.functions.numbers import fmt6, rint_round
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import TOKENS, Derived, r6, table, tokens, with_
from gaugeframe.plans.rules import LABEL_SQL, one

BASIC = r"trim(regexp_replace(translate(upper(strip_accents(replace(w, 'ß', 'ss'))), '–—−', '---'), '\s+', ' ', 'g'))"
CATEG = rf"trim(regexp_replace(regexp_replace({BASIC}, '[^A-Z0-9/&+\- ]+', ' ', 'g'), '\s+', ' ', 'g'))"
NUMER = rf"regexp_replace(replace(replace({BASIC}, 'R$', ''), '$', ''), '\s+', '', 'g')"


@query(with_(TOKENS, select="select w, n, lower(strip_accents(w)) as norm from token"))
def h01_norm_text(spark, sf):
    return tokens(spark, sf).withColumn("norm", T.norm_text(F.col("w")))


LABEL_SRC = "case when n % 3 = 0 then concat('Infra-Estrutura / ', w) when n % 3 = 1 then concat(w, '  /', w) else concat(' ', w, '   ', w) end"


@query(with_(TOKENS, f"p as (select {LABEL_SRC} as raw from token)",
             select=r"select raw, trim(regexp_replace(regexp_replace(replace(trim(lower(strip_accents(raw))), 'infra-estrutura', 'infraestrutura'), '\s*/\s*', ' e ', 'g'), '\s+', ' ', 'g')) as label from p"))
def h02_normalize_cat_label(spark, sf):
    return tokens(spark, sf).selectExpr(f"{LABEL_SRC} as raw").withColumn("label", T.cat_label(F.col("raw")))


@query(with_(TOKENS, select=f"select w, {BASIC} as basic, {CATEG} as categorical, {NUMER} as numeric from token"))
def h03_normalize_upper(spark, sf):
    w = F.col("w")
    return tokens(spark, sf).select("w", T.upper_basic(w).alias("basic"), T.upper_categorical(w).alias("categorical"), T.upper_numeric(w).alias("numeric"))


@query(with_(TOKENS, select=f"select w, {LABEL_SQL} as label from token"))
def h04_normalize_label(spark, sf):
    return tokens(spark, sf).select("w", T.upper_label(F.col("w")).alias("label"))


MULT = """case u when 'k' then cast(1e3 as double) when 'mil' then cast(1e3 as double) when 'm' then cast(1e6 as double) when 'milhao' then cast(1e6 as double) when 'milhoes' then cast(1e6 as double)
  when 'b' then cast(1e9 as double) when 'bilhao' then cast(1e9 as double) when 'bilhoes' then cast(1e9 as double) when '%' then null else cast(1 as double) end"""
UNIT_ROWS = Derived("q", "lineitem", {
    "v": "l_quantity / 8", "l_orderkey": "l_orderkey", "l_partkey": "l_partkey",
    "u0": "case l_partkey % 9 when 0 then 'Milhões' when 1 then 'mil' when 2 then 'K' when 3 then '%' when 4 then 'bilhão' when 5 then 'B' when 6 then '' when 7 then 'kg' end",
})


@query(with_(UNIT_ROWS.cte, "z as (select *, trim(lower(strip_accents(coalesce(u0, '')))) as u from q)", select=f"select u0, {MULT} as multiplier, count(*) as n from z group by all"))
def h05_unit_multiplier(spark, sf):
    g = UNIT_ROWS.spark(spark, sf).groupBy("u0").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("multiplier", T.unit_multiplier(F.col("u0")))


@query(with_(UNIT_ROWS.cte, "z as (select *, trim(lower(strip_accents(coalesce(u0, '')))) as u from q)", f"y as (select *, {MULT} as m from z)",
             select="""select l_orderkey, l_partkey, v, case when m is null then 'PCT' else 'NUM' end as typ,
               case when m is null then round_even(v * 1000000000.0, 0) / 1000000000.0 else round_even(v * m * 1000000.0, 0) / 1000000.0 end as value from y"""))
def h06_canonicalize_pairs(spark, sf):
    m = T.unit_multiplier(F.col("u0"))
    value = F.when(m.isNull(), rint_round(F.col("v"), 9)).otherwise(rint_round(F.col("v") * m, 6))
    return UNIT_ROWS.spark(spark, sf).select("l_orderkey", "l_partkey", "v", F.when(m.isNull(), "PCT").otherwise("NUM").alias("typ"), value.alias("value"))


G_ROWS = Derived("g", "orders", {"o_orderkey": "o_orderkey", "v": "case o_orderkey % 6 when 0 then o_totalprice when 1 then o_totalprice * 100 when 2 then o_totalprice / 1000 when 3 then o_totalprice / 10000000000 when 4 then cast(o_orderkey % 1000 as double) else -o_totalprice / 7 end"})


_G = lambda v: f"case when abs({v} - round_even({v}, 0)) < 1e-9 then cast(cast(round_even({v}, 0) as bigint) as varchar) else printf('%g', {v}) end"


@query(with_(G_ROWS.cte, select=f"""select o_orderkey, {_G('v')} as text, case when o_orderkey % 8 = 0 then '' else {_G('v')} || ' | ' || printf('%g', v / 1000) || '% | ' || {_G('cast(o_orderkey as double)')} || ' | ' || printf('%g', cast(o_orderkey * 1000000 as double)) || '%' end as joined from g"""))
def h07_canonical_numeric_text(spark, sf):
    """A single number, and a typed list with percentages."""
    item = lambda t, v: F.struct(F.lit(t).alias("typ"), v.cast("double").alias("value"))
    v, key = F.col("v"), F.col("o_orderkey")
    items = F.array(item("NUM", v), item("PCT", v / 1000), item("NUM", key), item("PCT", key * 1000000))
    some = F.filter(items, lambda i: key % 8 != 0)
    return G_ROWS.spark(spark, sf).select("o_orderkey", T.general_number(v).alias("text"), T.typed_numbers(some).alias("joined"))


SPEC_TEXT = Derived("s", "orders", {
    "o_orderkey": "o_orderkey",
    "spec": "concat(cast(o_orderkey % 100 as string), ' | ', cast(o_orderkey % 7 as string), '.5% |  | ', cast(o_orderkey as string), '.25')",
})


@query(with_(SPEC_TEXT.cte, "p as (select o_orderkey, unnest(string_split(spec, '|')) as part, generate_subscripts(string_split(spec, '|'), 1) - 1 as pos from s)",
             select="""select o_orderkey, pos, case when trim(part) like '%\\%' escape '\\' then 'PCT' else 'NUM' end as typ, cast(rtrim(trim(part), '%') as double) as value from p where trim(part) <> ''"""))
def h08_parse_f_numeric(spark, sf):
    from gaugeframe.operators.tick_compare import spec_numbers

    s = SPEC_TEXT.spark(spark, sf).select("o_orderkey", F.posexplode(F.split("spec", r"\|")).alias("pos", "part"))
    s = s.withColumn("pos", F.col("pos").cast("bigint"))
    return s.where(F.trim("part") != "").select("o_orderkey", "pos", spec_numbers(F.col("part")).alias("x")).select("o_orderkey", "pos", "x.typ", "x.value")


MANUAL_TEXT = Derived("m", "orders", {
    "o_orderkey": "o_orderkey",
    "manual": "concat('R$ ', cast(o_orderkey % 50 as string), ',5', case o_orderkey % 4 when 0 then ' mil' when 1 then '%' when 2 then ' Milhões' else '' end, ' | none | 0 | -', cast(o_orderkey % 9 as string), '.25', case o_orderkey % 3 when 0 then 'k' else '' end)",
})


@query(with_(MANUAL_TEXT.cte, "p as (select o_orderkey, unnest(string_split(manual, '|')) as part, generate_subscripts(string_split(manual, '|'), 1) - 1 as pos from m)",
             r"""e as (select o_orderkey, pos, regexp_extract(lower(strip_accents(part)), '(-?\d+(?:[\.,]\d+)?)\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])?', 1) as num,
               regexp_extract(lower(strip_accents(part)), '(-?\d+(?:[\.,]\d+)?)\s*(milhoes?|milhao|bilhoes?|bilhao|mil|[kmb%])?', 2) as unit from p)""",
             select="select o_orderkey, pos, cast(replace(num, ',', '.') as double) as value, unit from e where num <> ''"))
def h09_parse_manual_numeric(spark, sf):
    from gaugeframe.operators.tick_compare import number_and_unit

    m = MANUAL_TEXT.spark(spark, sf).select("o_orderkey", F.posexplode(F.split("manual", r"\|")).alias("pos", "part"))
    m = m.select("o_orderkey", F.col("pos").cast("bigint").alias("pos"), number_and_unit(F.col("part")).alias("x"))
    return m.where("x is not null").select("o_orderkey", "pos", "x.value", "x.unit")


NUM_RAW = "case n % 8 when 0 then w when 1 then concat('R$ ', cast(n as string), ',5') when 2 then concat('1.', cast(n % 1000 as string)) when 3 then concat('(', cast(n as string), 'K)') when 4 then concat('O', cast(n as string), '%') when 5 then concat(cast(n as string), 'MI') when 6 then concat(cast(n % 10 as string), ',', cast(100 + n % 900 as string)) else concat('l', cast(n as string)) end"
NUM_RX = T.NUMERIC_TOKEN
NUM_SQL = (
    TOKENS,
    f"p as (select raw, cast(sum(n) as bigint) as n from (select n, {NUM_RAW} as raw from token) group by raw)",
    f"q as (select *, {BASIC.replace('(w,', '(raw,')} as up from p)",
    r"b as (select *, regexp_replace(regexp_replace(replace(replace(up, 'R$', ''), '$', ''), '^[()\[\]{}:;]+|[()\[\]{}:;]+$', '', 'g'), '\s+', '', 'g') as bare from q)",
    r"f as (select *, case when regexp_matches(bare, '\d') then translate(bare, 'OIL', '011') else bare end as fixed, regexp_matches(bare, '[AC-HJNP-Z]') as foreign_letters from b)",
    f"t as (select *, regexp_extract(fixed, '{NUM_RX}', 1) as num, regexp_extract(fixed, '{NUM_RX}', 2) as suffix, (not foreign_letters) and regexp_matches(fixed, '{NUM_RX}') as ok from f)",
    r"""u as (select *, case when ok then cast(case when regexp_matches(num, ',\d{1,2}$') then replace(num, ',', '.') else replace(num, ',', '') end as double) end as value,
        case suffix when '' then cast(1 as double) when 'K' then cast(1e3 as double) when 'M' then cast(1e6 as double) when 'B' then cast(1e9 as double) end as factor from t)""",
)


@query(with_(*NUM_SQL, select="select raw, n, fixed as text, value, suffix, value * factor as full_value, case when up like '%$%' then 1 else 0 end as currency, case when up like '%\\%%' escape '\\' then 1 else 0 end as percent from u where ok"))
def h10_numeric_token(spark, sf):
    raw = tokens(spark, sf).selectExpr("n", f"{NUM_RAW} as raw").groupBy("raw").agg(F.sum("n").alias("n"))
    p = raw.select("raw", "n", T.numeric_token(F.col("raw")).alias("t")).where("t is not null")
    return p.select("raw", "n", "t.text", "t.value", "t.suffix", F.col("t.full").alias("full_value"), "t.currency", "t.percent")


SCALE_RAW = Derived("s", "orders", {"o_orderkey": "o_orderkey", "raw": "concat(case o_orderkey % 7 when 0 then '1e' when 1 then 'le+' when 2 then 'x10^' when 3 then '10' when 4 then '× 10' when 5 then 'I E-' else 'abc' end, case o_orderkey % 5 when 0 then cast(o_orderkey % 13 as string) when 1 then 'B' when 2 then '1O' when 3 then '⁶' else 'O8' end)"})


@query(with_(SCALE_RAW.cte,
             r"a as (select *, regexp_replace(regexp_replace(translate(upper(strip_accents(translate(raw, '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻', '0123456789+-'))), '×*−–—', 'XX---'), '\s+', '', 'g'), '^[IL]E', '1E') as t from s)",
             r"b as (select *, case when regexp_matches(t, '^1E[+-]?[0-9OB]{1,3}$') then regexp_extract(t, '^(1E[+-]?)([0-9OB]{1,3})$', 1) || translate(regexp_extract(t, '^(1E[+-]?)([0-9OB]{1,3})$', 2), 'OB', '08') else t end as t2 from a)",
             r"c as (select *, case when regexp_matches(t2, '^X?10\^?[+-]?[0-9OB]{1,3}$') then regexp_extract(t2, '^(X?10\^?[+-]?)([0-9OB]{1,3})$', 1) || translate(regexp_extract(t2, '^(X?10\^?[+-]?)([0-9OB]{1,3})$', 2), 'OB', '08') else t2 end as t3 from b)",
             select=r"select o_orderkey, raw, t3 as normalized, try_cast(nullif(regexp_extract(t3, '^(?:1E|X10\^?|10\^)([+-]?\d{1,3})$', 1), '') as integer) as exponent from c"))
def h11_scale_text(spark, sf):
    r = F.col("raw")
    return SCALE_RAW.spark(spark, sf).select("o_orderkey", "raw", T.scale_text(r).alias("normalized"), T.scale_exponent(r).alias("exponent"))


@query(r"""select doc_id, array_to_string(regexp_extract_all(upper(strip_accents(text)), '\b(19\d{2}|20\d{2}|21\d{2})\b', 1), '|') as years from documents""")
def h12_years(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.years(F.col("text")), "|").alias("years"))


YEARS_IN = r"len(regexp_extract_all(up, '\b(19\d{2}|20\d{2}|21\d{2})\b', 1))"
CATEG_UP = r"trim(regexp_replace(regexp_replace(up, '[^A-Z0-9/&+\- ]+', ' ', 'g'), '\s+', ' ', 'g'))"
KINDS = "k as (select u.*, kind from u, (select unnest(['categorical','temporal','numeric']) as kind))"


@query(with_(*NUM_SQL, select=rf"""select raw, n, len(regexp_replace({CATEG_UP}, '[^A-Z]', '', 'g')) >= 2 as categorical, {YEARS_IN} > 0 as temporal, ok as numeric from u"""))
def h13_token_usable(spark, sf):
    raw = tokens(spark, sf).selectExpr("n", f"{NUM_RAW} as raw").groupBy("raw").agg(F.sum("n").alias("n"))
    return raw.select("raw", "n", *[T.token_usable(F.col("raw"), F.lit(k)).alias(k) for k in ("categorical", "temporal", "numeric")])


@query(with_(*NUM_SQL, "s as (select *, cast(n % 120 as double) - 10 as conf from u)", select=rf"""select raw, n,
   greatest(-1.0::double, conf) + case when len(regexp_replace({CATEG_UP}, '[^A-Z]', '', 'g')) >= 3 then 25.0::double else 0 end + case when len({CATEG_UP}) >= 5 then 10.0::double else 0 end as categorical,
   greatest(-1.0::double, conf) + case when {YEARS_IN} > 0 then 45.0::double + 4.0::double * {YEARS_IN} else 0 end as temporal,
   greatest(-1.0::double, conf) + case when ok then 35.0::double else 0 end as numeric from s"""))
def h14_semantic_score(spark, sf):
    raw = tokens(spark, sf).selectExpr("n", f"{NUM_RAW} as raw").groupBy("raw").agg(F.sum("n").alias("n"))
    conf = (F.col("n") % 120).cast("double") - 10
    return raw.select("raw", "n", *[T.semantic_score(F.col("raw"), conf, F.lit(k)).alias(k) for k in ("categorical", "temporal", "numeric")])


@query(with_(TOKENS, f"l as (select w, {LABEL_SQL} as label from token)", r"c as (select w, len(regexp_replace(label, '[^A-Z0-9]', '', 'g')) as both_n, len(regexp_replace(label, '[^A-Z]', '', 'g')) as alpha_n from l)",
             select=f"select w, case when both_n = 0 then 0.0::double else {r6('alpha_n / both_n')} end as alpha_ratio, case when both_n = 0 then 0.0::double else {r6('(both_n - alpha_n) / both_n')} end as numeric_ratio from c"))
def h15_char_ratios(spark, sf):
    w = F.col("w")
    return tokens(spark, sf).select("w", rint_round(T.alpha_ratio(w)).alias("alpha_ratio"), rint_round(T.numeric_ratio(w)).alias("numeric_ratio"))


BOX_PAIR = Derived("b", "lineitem", {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
    "ax1": "l_partkey % 1000", "ay1": "l_suppkey % 700", "ax2": "l_partkey % 1000 + cast(l_quantity as bigint)", "ay2": "l_suppkey % 700 + l_linenumber * 9",
    "bx1": "l_orderkey % 1000", "by1": "l_suppkey % 690", "bx2": "l_orderkey % 1000 + 300", "by2": "l_suppkey % 690 + 60",
})


@query(with_(BOX_PAIR.cte, select=f"""select l_orderkey, l_partkey, l_suppkey, {r6('greatest(0, least(ax2,bx2) - greatest(ax1,bx1)) * greatest(0, least(ay2,by2) - greatest(ay1,by1)) / greatest(1, (ax2-ax1)*(ay2-ay1))')} as overlap,
   cast(greatest(0, ax1 - floor((ax2-ax1)*0.18::double)) as bigint) as ex1, cast(greatest(0, ay1 - floor((ay2-ay1)*0.18::double)) as bigint) as ey1,
   cast(least(1200, ax2 + floor((ax2-ax1)*0.18::double)) as bigint) as ex2, cast(least(800, ay2 + floor((ay2-ay1)*0.18::double)) as bigint) as ey2 from b"""))
def h16_overlap_expand(spark, sf):
    a = tuple(F.col(c) for c in ("ax1", "ay1", "ax2", "ay2"))
    b = tuple(F.col(c) for c in ("bx1", "by1", "bx2", "by2"))
    grown = G.expand_box(a, F.lit(1200), F.lit(800))
    return BOX_PAIR.spark(spark, sf).select(
        "l_orderkey", "l_partkey", "l_suppkey", rint_round(G.overlap_share(a, b)).alias("overlap"),
        *[c.cast("bigint").alias(n) for n, c in zip(("ex1", "ey1", "ex2", "ey2"), grown)],
    )


FLOATS = Derived("f", "events", {"event_id": "event_id", "raw": "case event_id % 5 when 0 then 'bad' when 1 then 'NaN' when 2 then cast(value as string) when 3 then concat(' ', cast(event_id as string), '.1234565') end"})


@query(with_(FLOATS.cte, "g as (select event_id, nullif(try_cast(trim(raw) as double), 'NaN'::double) as x from f)", select=f"select event_id, x, {r6('x')} as fmt from g"))
def h17_safe_float_fmt(spark, sf):
    from gaugeframe.functions.numbers import safe_float

    return FLOATS.spark(spark, sf).select("event_id", safe_float(F.col("raw")).alias("x"), fmt6(F.col("raw")).alias("fmt"))


PROMPTS = Derived("p", "orders", {
    "line_no": "o_orderkey",
    "unit_id": "concat(case o_orderkey % 6 when 0 then 'BI' when 1 then 'BC' when 2 then 'LI' when 3 then 'LC' when 4 then 'SI' else 'XX' end, '_', lpad(cast(o_custkey % 1000 as string), 3, '0'))",
    "prompt_text": "case when o_orderkey % 23 <> 0 then concat('Draw ', o_orderpriority, ' by ', o_orderstatus) end",
    "prompt_file": "case o_orderkey % 10 when 0 then 'other.txt' when 1 then '' when 2 then null else concat('dir/', concat(case o_orderkey % 6 when 0 then 'BI' when 1 then 'BC' when 2 then 'LI' when 3 then 'LC' when 4 then 'SI' else 'XX' end, '_', lpad(cast(o_custkey % 1000 as string), 3, '0')), '.txt') end",
    "rep2": "case when o_orderkey % 8 = 0 then '_R01.png' else '_R02.png' end",
    "other": "case when o_orderkey % 12 = 0 then 'BI_001_R03.jpg' when o_orderkey % 14 = 0 then 'broken.bmp' else '' end",
    "participant_id": "o_custkey", "condition": "o_orderstatus",
})
IMGS_SQL = "list_filter([unit_id || '_R01.png', 'x/' || unit_id || rep2, other], lambda s: s <> '') as images"
REASON = r"""case when not regexp_full_match(unit_id, '(BI|BC|LI|LC|SI|SC)_\d{3}') then 'BAD_UNIT_ID' when prompt_text is null then 'NO_PROMPT'
  when coalesce(prompt_file, '') <> '' and list_extract(string_split(prompt_file, '/'), -1) <> unit_id || '.txt' then 'PROMPT_FILE_MISMATCH'
  when len(list_filter(names, lambda s: not regexp_full_match(s, '(?i)(BI|BC|LI|LC|SI|SC)_\d{3}_R\d{2}\.(png|jpg|jpeg)'))) > 0 then 'BAD_IMAGE_NAME'
  when len(list_filter(names, lambda s: upper(substr(s, 1, 6)) <> unit_id)) > 0 then 'IMAGE_OF_OTHER_UNIT'
  when len(list_distinct(list_transform(names, lambda s: substr(s, 9, 2)))) < len(names) then 'DUPLICATE_REPEAT'
  when n_same > 1 then 'DUPLICATE_UNIT' end"""
PROMPT_CTES = (
    PROMPTS.cte,
    f"i as (select *, {IMGS_SQL} from p)",
    "c as (select i.*, list_transform(images, lambda s: list_extract(string_split(s, '/'), -1)) as names, d.n_same from i join (select unit_id, count(*) as n_same from p group by unit_id) d using (unit_id))",
)


def prompts(spark, sf):
    p = PROMPTS.spark(spark, sf)
    imgs = F.expr("filter(array(concat(unit_id, '_R01.png'), concat('x/', unit_id, rep2), other), s -> s <> '')")
    return p.withColumn("images", imgs).drop("rep2", "other")


@query(with_(*PROMPT_CTES, select=f"select line_no, unit_id, {REASON} as reject_reason from c"))
def h18_validate_prompt_record(spark, sf):
    from gaugeframe.sources.prompts import validate_prompts

    return validate_prompts(prompts(spark, sf)).select("line_no", "unit_id", "reject_reason")


COND = Derived("c", "customer", {"c_custkey": "c_custkey", "code": "case c_custkey % 4 when 0 then concat(cast(c_nationkey as string), '.0') when 1 then cast(c_nationkey as string) when 2 then concat('1', cast(c_nationkey as string), '0') end"})


@query(with_(COND.cte, r"d as (select c_custkey, regexp_replace(code, '\.0$', '') as k from c)", select="select c_custkey, case when len(k) < 2 then lpad(k, 2, '0') else k end as condition_code from d"))
def h19_condition_code_pad(spark, sf):
    return COND.spark(spark, sf).select("c_custkey", T.pad_condition(F.col("code")).alias("condition_code"))


@query(with_(*PROMPT_CTES, select=f"""select line_no, unit_id, unit_id || '.txt' as prompt_file, participant_id, condition, len(names) as n_images, names[1] as first_image, names[-1] as last_image,
   sha256(prompt_text) as prompt_sha256 from c where prompt_text is not null"""))
def h20_prompt_manifest(spark, sf):
    from gaugeframe.sources.prompts import prompt_manifest

    m = prompt_manifest(prompts(spark, sf).where("prompt_text is not null"), ["line_no", "participant_id", "condition"])
    return m.withColumn("n_images", F.col("n_images").cast("bigint"))


@query("""select o_orderkey, case when o_totalprice * 20 >= 1000000 then cast(cast(floor(o_totalprice * 20 / 1000000) as bigint) as varchar) || 'M'
   when o_totalprice * 20 >= 1000 then cast(cast(floor(o_totalprice * 20 / 1000) as bigint) as varchar) || 'K' else cast(cast(floor(o_totalprice * 20) as bigint) as varchar) end as tick from orders""")
def h21_axis_tick_label(spark, sf):
    from gaugeframe.functions.status import abbreviate

    return table(spark, sf, "orders").select("o_orderkey", abbreviate(F.col("o_totalprice") * 20).alias("tick"))
