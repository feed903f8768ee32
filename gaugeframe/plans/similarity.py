"""Component texts, text and vector similarity, score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions.numbers import rint_round
from gaugeframe.functions.similarity import list_similarity, text_similarity
from gaugeframe.operators import score_export as X
from gaugeframe.operators import similarity as S
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import r6, table, with_
from gaugeframe.plans.rates import SC_CONDS, SC_TASKS, SCORE_SUM, SCORES

# every word of every whole text is a token; some carry an axis word or an amount
WORD = "case when pos % 97 = 5 then concat('Setor ', w) when pos % 41 = 7 then concat('R$ ', cast(pos as string), ',50') when pos % 211 = 3 then 'Nomes das medidas' else w end"


def ocr_tokens(documents):
    t = documents.select("doc_id", F.posexplode(F.split("text", r"[ \n\t\r]+")).alias("pos", "w"))
    return t.selectExpr("doc_id", "pos", f"{WORD} as text", "pos * 13 % 1200 as x", "pos * 13 % 1200 / 1200 as x_norm", "pos * 7 % 100 / 100 as y_norm")


TOK_SQL = (
    r"t0 as (select doc_id, unnest(a) as w, generate_subscripts(a, 1) - 1 as pos from (select doc_id, regexp_split_to_array(text, '[ \n\t\r]+') as a from documents))",
    f"tk as (select doc_id, pos, {WORD} as text, pos * 13 % 1200 as x, pos * 13 % 1200 / 1200 as x_norm, pos * 7 % 100 / 100 as y_norm from t0)",
    r"""fl as (select *, y_norm < 0.05 as is_t, x_norm > 0.85 and lower(text) <> 'nomes das medidas' as is_l, contains(lower(text), 'setor') as is_x,
        y_norm >= 0.90 and not contains(lower(text), 'setor') and not contains(text, 'R$') and not regexp_matches(text, '\d') and length(text) >= 5 as is_c, regexp_matches(text, 'R\$\s*[\d,.]+') as is_v from tk)""",
    """cp as (select doc_id, coalesce(trim(string_agg(text, ' ' order by x, pos) filter (where is_t)), '') as title, coalesce(string_agg(text, '|' order by pos) filter (where is_l), '') as legend,
        coalesce(string_agg(text, '|' order by x, pos) filter (where is_c), '') as categories, coalesce(string_agg(text, '|' order by pos) filter (where is_v), '') as "values", coalesce(arg_min(text, pos) filter (where is_x), '') as x_axis from fl group by doc_id)""",
)


@query(with_(*TOK_SQL, select="select * from cp"))
def g19_ocr_components(spark, sf):
    docs = table(spark, sf, "documents")
    c = S.components(ocr_tokens(docs), "doc_id", docs)
    return c.select("doc_id", "title", "x_axis", *[F.array_join(n, "|").alias(n) for n in S.LISTS])


# ------------------------------------------------------------------------------- LCS as a SQL twin
def lcs_sql(pairs: str, out: str) -> tuple[str, ...]:
    """Bit-vector LCS over distinct pairs ``a, b`` (``b`` up to 60 characters) as a recursive CTE."""
    bit = "cast(list_sum(list_transform(range(1, length(p.b) + 1), lambda j: case when substr(p.b, cast(j as integer), 1) = substr(p.a, st.i + 1, 1) then cast(1 as bigint) << (cast(j as integer) - 1) else 0 end)) as bigint)"
    full = "((cast(1 as bigint) << cast(length(p.b) as integer)) - 1)"
    return (
        f"st as (select a, b, 0 as i, ((cast(1 as bigint) << cast(length(b) as integer)) - 1) as v from {pairs} where a <> '' and b <> '' union all "
        f"select st.a, st.b, st.i + 1, ((st.v + (st.v & {bit})) | (st.v - (st.v & {bit}))) & {full} from st join {pairs} p on p.a = st.a and p.b = st.b where st.i < length(st.a))",
        f"{out} as (select {pairs}.a, {pairs}.b, case when {pairs}.a = {pairs}.b then 1.0::double when {pairs}.a = '' or {pairs}.b = '' then 0.0::double else 2.0::double * (length({pairs}.b) - bit_count(v)) / (length({pairs}.a) + length({pairs}.b)) end as sim "
        f"from {pairs} left join st on st.a = {pairs}.a and st.b = {pairs}.b and st.i = length({pairs}.a))",
    )


REF, OUT = "case when p_size > 2 then p_name end", "case when p_size < 48 then concat(p_type, ' ', p_name) end"
LREF, LOUT = "case when p_size > 5 then concat(p_name, ' ', p_brand) else '' end", "case when p_size < 45 then concat(p_brand, ' ', p_name, ' ', p_type) else '' end"


@query("with recursive " + ",\n".join([
    f"base as (select p_partkey, {REF} as ref, {OUT} as gen, string_split({LREF}, ' ') as la, string_split({LOUT}, ' ') as lb, {LREF} as ta, {LOUT} as tb from part)",
    "pos as (select distinct ta, tb, unnest(la) as a, generate_subscripts(la, 1) as i from base where ta <> ''), pob as (select distinct ta, tb, unnest(lb) as b, generate_subscripts(lb, 1) as i from base where tb <> '')",
    "lp as (select ta, tb, coalesce(pos.i, pob.i) as i, a, b from pos full join pob using (ta, tb, i) where ta <> '' and tb <> '')",
    "prs as (select distinct ref as a, gen as b from base where ref is not null and gen is not null union select distinct a, b from lp where a is not null and b is not null)",
    *lcs_sql("prs", "sm"),
    "ls as (select ta, tb, avg(coalesce(sim, 0)) as s from lp left join sm on sm.a = lp.a and sm.b = lp.b group by 1, 2)",
]) + f""" select p_partkey, {r6('case when ref is null and gen is null then 1.0 when ref is null or gen is null then 0.0 else sm.sim end')} as scalar,
   {r6("case when base.ta = '' and base.tb = '' then 1.0 when base.ta = '' or base.tb = '' then 0.0 else ls.s end")} as list from base left join sm on sm.a = base.ref and sm.b = base.gen left join ls on ls.ta = base.ta and ls.tb = base.tb""")
def g20_text_similarity(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{REF} as ref", f"{OUT} as gen", f"{LREF} as ta", f"{LOUT} as tb")
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    return p.select("p_partkey", rint_round(text_similarity(F.col("ref"), F.col("gen"))).alias("scalar"), rint_round(list_similarity(words("ta"), words("tb"))).alias("list"))


# ------------------------------------------------------------- LCS of texts of any length, as SQL
def long_lcs_sql(pairs: str, out: str, bits: int = 60) -> tuple[str, ...]:
    """The bit-vector recurrence over lists of ``bits``-bit words, for distinct pairs ``a, b`` of any length.

    A sum of two lists needs the carry into each word: there is one if the words before it end in one that
    overflows (G) and any number that are full (P).
    """
    full = f"((cast(1 as bigint) << {bits}) - 1)"
    return (
        f"ch as (select b, c, [cast(coalesce(list_sum(list_transform(list_filter(js, lambda j: (j - 1) // {bits} = w), lambda j: cast(1 as bigint) << cast((j - 1) % {bits} as integer))), 0) as bigint) for w in range(0, cast(ceil(length(b) / {bits}.0) as bigint))] as m "
        f"from (select b, c, list(j) as js from (select b, j, substr(b, cast(j as integer), 1) as c from (select b, unnest(range(1, length(b) + 1)) as j from (select distinct b from {pairs}))) group by b, c))",
        # characters of a that b lacks change nothing
        f"ss as (select a, b, list(m order by i) as ms from (select a, b, substr(a, cast(i as integer), 1) as c, i from (select a, b, unnest(range(1, length(a) + 1)) as i from {pairs} where a <> b)) join ch using (b, c) group by a, b)",
        f"st as (select a, b, list_reduce(ms, lambda v, m: list_transform([[v[k] + (v[k] & m[k]) for k in range(1, length(v) + 1)]], lambda s: "
        f"list_transform([list_aggregate([case when x > {full} then 'G' when x = {full} then 'P' else 'K' end for x in s], 'string_agg', '')], lambda g: "
        f"[((s[k] + case when regexp_matches(g[1:k - 1], 'GP*$') then 1 else 0 end) & {full}) | (v[k] & ~m[k]) for k in range(1, length(v) + 1)])[1])[1], [{full} for x in ms[1]]) as v from ss)",
        # set bits of the last state are characters of b outside the subsequence, apart from the unused ones
        f"{out} as (select p.a, p.b, case when p.a = p.b then 1.0::double when p.a = '' or p.b = '' then 0.0::double else 2.0::double * (case when e.v is null then 0 else {bits} * length(e.v) - cast(list_sum([bit_count(x) for x in e.v]) as bigint) end) / (length(p.a) + length(p.b)) end as sim "
        f"from {pairs} p left join st e on e.a = p.a and e.b = p.b)",
    )


_SCALARS, _LISTS = ("title", "x_axis"), tuple(S.LISTS)
_PART_LISTS = "li0 as (select doc_id, " + ", ".join(f"coalesce(list(text order by {o}) filter (where {c}), []) as \"{f}\"" for f, o, c in (("legend", "pos", "is_l"), ("categories", "x, pos", "is_c"), ("values", "pos", "is_v"))) + " from fl group by doc_id)"


@query("with " + ",\n".join([
    *TOK_SQL, _PART_LISTS, "fs as (select lang, min(doc_id) as ref_id from documents group by lang)",
    "tx as (select d.doc_id, d.lang, d.lang <> 'es' as cv, " + ", ".join([f"r.{f} as r_{f}, g.{f} as g_{f}" for f in _SCALARS] + [f"rl.\"{f}\" as r_{f}, gl.\"{f}\" as g_{f}" for f in _LISTS])
    + " from documents d join fs using (lang) join cp g on g.doc_id = d.doc_id join cp r on r.doc_id = fs.ref_id join li0 gl on gl.doc_id = d.doc_id join li0 rl on rl.doc_id = fs.ref_id)",
    "it as (" + " union all ".join(f"select doc_id, '{f}' as f, unnest(list_zip(r_{f}[1:least(len(r_{f}), len(g_{f}))], g_{f}[1:least(len(r_{f}), len(g_{f}))])) as x from tx" for f in _LISTS) + ")",
    "prs as (" + " union ".join([f"select g_{f} as a, r_{f} as b from tx" for f in _SCALARS] + ["select x[2], x[1] from it"]) + ")",
    *long_lcs_sql("prs", "sm"),
    "li as (select doc_id, f, sum(sim) as s from it join sm on sm.a = x[2] and sm.b = x[1] group by doc_id, f)",
    "sc as (select tx.doc_id, lang, cv, " + ", ".join([f"{f}_sm.sim as s_{f}" for f in _SCALARS] + [f"case when len(r_{f}) = 0 and len(g_{f}) = 0 then 1.0 when len(r_{f}) = 0 or len(g_{f}) = 0 then 0.0 else {f}_li.s / greatest(len(r_{f}), len(g_{f})) end as s_{f}" for f in _LISTS])
    + " from tx " + " ".join([f"join sm {f}_sm on {f}_sm.a = g_{f} and {f}_sm.b = r_{f}" for f in _SCALARS] + [f"left join li {f}_li on {f}_li.doc_id = tx.doc_id and {f}_li.f = '{f}'" for f in _LISTS]) + ")",
]) + f""" select doc_id, lang, {', '.join(f"{r6(f's_{f}')} as s_{f}" for f in (*_SCALARS, 'legend', 'categories'))}, case when cv then {r6('s_values')} end as s_values,
   {r6('case when cv then (s_title + s_x_axis + s_legend + s_categories + s_values) / 5 else (s_title + s_x_axis + s_legend + s_categories) / 4 end')} as ocr from sc""")
def g21_text_score(spark, sf):
    """Every document against the first document of its language, over whole texts."""
    docs = table(spark, sf, "documents")
    # references are chosen first, so only their texts are taken apart a second time
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    chosen = docs.join(first, ["doc_id", "lang"])
    parts = lambda d: S.components(ocr_tokens(d), "doc_id", d).join(d.select("doc_id", "lang"), "doc_id")
    c, ref = parts(docs), parts(chosen).withColumn("compare_values", F.col("lang") != "es")
    s = S.text_scores(c, ref, "lang")
    return s.select("doc_id", "lang", *[rint_round(F.col(f"s_{f}")).alias(f"s_{f}") for f in ("title", "x_axis", *S.LISTS)], rint_round(F.col("ocr")).alias("ocr"))


VEC_SQL = ("rf as (select label, arg_min(embedding, vec_id) as rv, min(vec_id) as ref_key from embeddings group by label)",
           f"cl as (select vec_id, e.label, ref_key, {r6('list_cosine_similarity(embedding::double[], rv::double[])')} as clip from embeddings e join rf using (label) where vec_id <> ref_key)")


@query(with_(*VEC_SQL, select="select * from cl"))
def g22_embedding_similarity(spark, sf):
    return S.vector_scores(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").withColumn("clip", rint_round(F.col("clip")))


IMAGE_NAME = "concat('img', cast(vec_id as string), case when vec_id % 3 = 0 then '.jpg' else '.png' end)"
OCR_PAIR = "concat('setor ', cast(label as string)) as a, concat('Setor', cast(vec_id % 7 as string)) as b"


@query("with recursive " + ",\n".join([
    *VEC_SQL, f"im as (select vec_id, label as task, {IMAGE_NAME} as image, {OCR_PAIR} from embeddings)", "prs as (select distinct a, b from im)", *lcs_sql("prs", "sm"),
    "er as (select event_id, 'OCR failed' as error from events where event_type = 'error')",
]) + f""" select im.vec_id, im.task, im.image, replace(im.image, '.png', '') as trial, case when er.error is null then {r6('sm.sim')} end as ocr, case when er.error is null then cl.clip end as clip, coalesce(er.error, 'OK') as status
   from im left join sm using (a, b) left join cl on cl.vec_id = im.vec_id left join er on er.event_id = im.vec_id""")
def g23_score_long(spark, sf):
    e = table(spark, sf, "embeddings")
    images = e.selectExpr("vec_id", "label as task", f"{IMAGE_NAME} as image")
    ocr = e.selectExpr("vec_id", *OCR_PAIR.replace(" as a, ", " as a;").split(";")).select("vec_id", rint_round(text_similarity(F.col("a"), F.col("b"))).alias("ocr"))
    clip = S.vector_scores(e, "vec_id", "label", "embedding").select("vec_id", rint_round(F.col("clip")).alias("clip"))
    errors = table(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id as vec_id", "'OCR failed' as error")
    return S.score_long(images, ocr, clip, errors, "vec_id")


@query(with_(*SCORE_SUM, "su as (select participant, condition, task, avg(clip) / 100.0 as clip from ex group by all)",
             select="select participant, " + ", ".join(f"round_even(avg(clip) filter (where condition = '{c}' and task = '{t}') * 100.0, 0) / 100.0 as \"{c}_{t}\"" for c in SC_CONDS for t in SC_TASKS) + " from su group by participant"))
def a11_export_bundle(spark, sf):
    """The four export tables are written and the CLIP pivot is read back."""
    from gaugeframe.sources.tables import scratch_folder, write_tables

    folder = scratch_folder(spark)
    write_tables(X.export_bundle(SCORES.spark(spark, sf), SC_CONDS, SC_TASKS), folder)
    return spark.read.parquet(f"{folder}/clip")
