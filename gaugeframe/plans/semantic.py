"""The 48 chart questions over yearly, sector and rate series, and answer scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gaugeframe.functions.numbers import ratio
from gaugeframe.operators import semantic as Q
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import r6, table, with_


def series(spark, sf):
    o, c, li = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    y = F.year("o_orderdate")
    yearly = o.groupBy(y.alias("ord")).agg(F.sum(F.when(status == "F", price)).alias("op"), F.sum(F.when(status == "O", price)).alias("disb"))
    # orders are summed per customer before they meet the customer table
    per = o.groupBy("o_custkey").agg(F.sum(F.when(status == "F", price)).alias("op"), F.sum(F.when(status == "O", price)).alias("disb"))
    sector = per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("ord")).agg(F.sum("op").alias("op"), F.sum("disb").alias("disb"))
    flag, ext = F.col("l_returnflag"), F.col("l_extendedprice")
    rate = li.groupBy(F.col("l_discount").alias("ord")).agg(F.sum(F.when(flag == "A", ext)).alias("op"), F.sum(F.when(flag == "R", ext)).alias("disb"))
    return {n: d.withColumn("k", F.col("ord").cast("string")) for n, d in (("yearly", yearly), ("sector", sector), ("rate", rate))}


SERIES_SQL = (
    "yearly as (select year(o_orderdate) as ord, cast(year(o_orderdate) as varchar) as k, sum(o_totalprice) filter (where o_orderstatus = 'F') as op, sum(o_totalprice) filter (where o_orderstatus = 'O') as disb from orders group by 1, 2)",
    "sector as (select c_mktsegment as ord, c_mktsegment as k, sum(o_totalprice) filter (where o_orderstatus = 'F') as op, sum(o_totalprice) filter (where o_orderstatus = 'O') as disb from orders join customer on o_custkey = c_custkey group by 1, 2)",
    "rate as (select l_discount as ord, cast(l_discount as varchar) as k, sum(l_extendedprice) filter (where l_returnflag = 'A') as op, sum(l_extendedprice) filter (where l_returnflag = 'R') as disb from lineitem group by 1, 2)",
    "steps as (select *, lag(k) over (order by ord) as prev_k, disb - lag(disb) over (order by ord) as rise_disb from yearly)",
)


def m(v):
    return f"replace(format('{{:,}}', cast(round_even({v}, 0) as bigint)), ',', '.')"


def v(k, c):
    return f"max(case when k = '{k}' then {c} end)"


def yn(c):
    return f"case when {c} then 'verdadeiro' else 'falso' end"


def rank_sql(c, keys=None):
    cond = "" if keys is None else " filter (where k in (" + ", ".join(f"'{k}'" for k in keys) + "))"
    return f"string_agg(k, ' > ' order by {c} desc, k){cond}"


def gt(k):
    return f"case when {v(k, 'op')} >= {v(k, 'disb')} then 'Operação' else 'Desembolso' end"


def arrow(c, a, b):
    return f"case when {v(b, c)} > {v(a, c)} then '↑' else '↓' end"


A, B, C_ = "1996", "1998", "2000"
S1, S2, S3 = "BUILDING", "MACHINERY", "FURNITURE"
R1, R2, R3 = "0.01", "0.05", "0.08"
BOTH_MAX = "'Operação=' || first(k order by op desc nulls last, k) || '; Desembolso=' || first(k order by disb desc nulls last, k)"
# id -> (column builder, twin)
YEARLY = {
    "LI-01": (lambda: Q.point(A, "disb"), m(v(A, "disb"))), "LI-02": (lambda: Q.point(B, "disb"), m(v(B, "disb"))), "LI-03": (lambda: Q.point(C_, "disb"), m(v(C_, "disb"))),
    "LI-04": (lambda: Q.arg_max("disb"), "first(k order by disb desc nulls last, k)"), "LI-05": (lambda: Q.arg_min("disb"), "first(k order by disb nulls last, k)"),
    "LI-06": (lambda: Q.is_greater(C_, B, "disb"), yn(f"{v(C_, 'disb')} > {v(B, 'disb')}")), "LI-07": (lambda: Q.is_greater(A, B, "disb"), yn(f"{v(A, 'disb')} > {v(B, 'disb')}")),
    "LI-08": (lambda: Q.largest_rise("disb"), "first(prev_k || '–' || k order by rise_disb desc nulls last, k)"),
    "LC-01": (lambda: Q.point(A, "op"), m(v(A, "op"))), "LC-02": (lambda: Q.point(C_, "disb"), m(v(C_, "disb"))), "LC-03": (lambda: Q.point(C_, "op"), m(v(C_, "op"))),
    "LC-04": (lambda: Q.larger_series(B), gt(B)), "LC-05": (lambda: Q.larger_series(C_), gt(C_)), "LC-06": (lambda: Q.maxima(), BOTH_MAX), "LC-07": (lambda: Q.arg_max_gap(), "first(k order by abs(op - disb) desc nulls last, k)"),
    "LC-08": (lambda: Q.same_direction(B, C_), f"case when {arrow('op', B, C_)} = {arrow('disb', B, C_)} then 'verdadeiro' else 'não; Operação ' || {arrow('op', B, C_)} || '; Desembolso ' || {arrow('disb', B, C_)} end"),
}
SECTOR = {
    "BI-01": (lambda: Q.point(S1, "op"), m(v(S1, "op"))), "BI-02": (lambda: Q.point(S2, "op"), m(v(S2, "op"))), "BI-03": (lambda: Q.point(S3, "op"), m(v(S3, "op"))),
    "BI-04": (lambda: Q.arg_max("op"), "first(k order by op desc nulls last, k)"), "BI-05": (lambda: Q.arg_min("op"), "first(k order by op nulls last, k)"), "BI-06": (lambda: Q.is_greater(S2, S3, "op"), yn(f"{v(S2, 'op')} > {v(S3, 'op')}")),
    "BI-07": (lambda: Q.ranking("op"), rank_sql("op")), "BI-08": (lambda: Q.above("op", 250_000_000.0), "coalesce(string_agg(k, ', ' order by op desc, k) filter (where op > 250000000), '')"),
    "BC-01": (lambda: Q.point(S2, "op"), m(v(S2, "op"))), "BC-02": (lambda: Q.point(S2, "disb"), m(v(S2, "disb"))), "BC-03": (lambda: Q.point(S3, "op"), m(v(S3, "op"))),
    "BC-04": (lambda: Q.larger_series(S1), gt(S1)), "BC-05": (lambda: Q.larger_series(S3), gt(S3)), "BC-06": (lambda: Q.arg_max("op"), "first(k order by op desc nulls last, k)"), "BC-07": (lambda: Q.ranking("disb"), rank_sql("disb")),
    "BC-08": (lambda: Q.for_all(), yn("bool_and(op > disb)")),
}
RATE = {
    "SI-01": (lambda: Q.point(R1, "op"), m(v(R1, "op"))), "SI-02": (lambda: Q.point(R2, "op"), m(v(R2, "op"))), "SI-03": (lambda: Q.point(R3, "op"), m(v(R3, "op"))),
    "SI-04": (lambda: Q.arg_max("op"), "first(k order by op desc nulls last, k)"), "SI-05": (lambda: Q.largest_key(), "arg_max(k, ord)"), "SI-06": (lambda: Q.is_greater(R2, R3, "op"), yn(f"{v(R2, 'op')} > {v(R3, 'op')}")),
    "SI-07": (lambda: Q.ranking("op", [R1, R2, R3]), rank_sql("op", [R1, R2, R3])), "SI-08": (lambda: Q.best_among("op", "ord > 0.06D"), "first(k order by op desc nulls last, k) filter (where ord > 0.06)"),
    "SC-01": (lambda: Q.point(R1, "op"), m(v(R1, "op"))), "SC-02": (lambda: Q.point(R2, "disb"), m(v(R2, "disb"))), "SC-03": (lambda: Q.point(R1, "disb"), m(v(R1, "disb"))),
    "SC-04": (lambda: Q.larger_series(R1), gt(R1)), "SC-05": (lambda: Q.op_above(R3), yn(f"{v(R3, 'op')} > {v(R3, 'disb')}")), "SC-06": (lambda: Q.maxima(), BOTH_MAX),
    "SC-07": (lambda: Q.exists(), yn("bool_or(op > disb)")), "SC-08": (lambda: Q.arg_max_gap(True), "first(k order by op - disb desc nulls last, k)"),
}
BANK = {"yearly": YEARLY, "sector": SECTOR, "rate": RATE}
ANSWERS_SQL = "ans as (" + " union all ".join(
    f"select '{q[:2]}' as profile, '{q}' as id, cast({sql} as varchar) as answer from {'steps' if s == 'yearly' else s}" for s, qs in BANK.items() for q, (_, sql) in qs.items()
) + ")"


def answers(spark, sf):
    s = series(spark, sf)
    s["yearly"] = Q.with_steps(s["yearly"])
    return reduce(lambda a, b: a.unionByName(b), [Q.answer(s[n], {q: c() for q, (c, _) in qs.items()}) for n, qs in BANK.items()])


@query(with_(*SERIES_SQL, ANSWERS_SQL, select="select * from ans"))
def g26_semantic_questions(spark, sf):
    return answers(spark, sf)


GIVEN = "case substr(id, 5, 1) when '3' then concat(answer, '?') when '4' then concat('  ', upper(answer)) when '5' then null else answer end"


@query(with_(*SERIES_SQL, ANSWERS_SQL, f"gv as (select id, {GIVEN} as given from ans)",
             r"cm as (select ans.profile, case when trim(regexp_replace(lower(strip_accents(coalesce(ans.answer, ''))), '\s+', ' ', 'g')) = trim(regexp_replace(lower(strip_accents(coalesce(gv.given, ''))), '\s+', ' ', 'g')) then 1 else 0 end as is_match from ans left join gv using (id))",
             select=f"select profile, count(*) as n_questions, cast(sum(is_match) as bigint) as n_match, {r6('sum(is_match) / count(*)')} as accuracy from cm group by profile"))
def g27_answer_compare(spark, sf):
    truth = answers(spark, sf)
    given = truth.select("id", F.expr(GIVEN).alias("answer"))
    c = Q.compare_answers(given, truth)
    return c.groupBy("profile").agg(F.count(F.lit(1)).alias("n_questions"), F.sum("is_match").alias("n_match"), ratio(F.sum("is_match"), F.count(F.lit(1))).alias("accuracy"))
