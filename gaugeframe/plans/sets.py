"""Key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import sets as S
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import table, with_
from gaugeframe.plans.joins import USED, used_units


@query("select o_custkey as unit_id from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000 intersect select o_custkey from orders where o_orderstatus = 'P' and o_totalprice < 50000")
def f01_split_overlap(spark, sf):
    return S.overlap(*used_units(spark, sf), "unit_id")


@query("""select k as filename, case when d > 0 then 'MISSING' else 'UNEXPECTED' end as side, abs(d) as n from (
  select k, cast(sum(d) as bigint) as d from (select o_orderkey as k, 1 as d from orders union all select l_orderkey, -1 from lineitem) group by k) where d <> 0""")
def f02_key_reconcile(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"))
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filename"))
    return S.reconcile(expected, found, "filename")


@query("select doc_id as id, lang, n_chars, cast(null as varchar) as role from documents union all select conv_id, null, null, role from conversations")
def f03_union_by_name(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id as id", "lang", "n_chars")
    c = table(spark, sf, "conversations").selectExpr("conv_id as id", "role")
    return d.unionByName(c, allowMissingColumns=True)


@query(with_(USED, select="select unit_id from used"))
def f04_union_used_units(spark, sf):
    return S.union_keys(*used_units(spark, sf))
