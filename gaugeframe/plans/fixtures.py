"""Descriptor tables derived from the given tables, once for Spark and once as SQL text.

No images ship with the data, so every descriptor (flag, colour, position, confidence) is a plain
expression over a real row; both engines evaluate the same expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(expr: str) -> str:
    """SQL twin of ``rint_round(…, 6)``."""
    return f"(round_even(({expr}) * 1000000.0, 0) / 1000000.0)"


def with_(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


# ------------------------------------------------------------------------------------------ units
UNIT = """unit as (
  select c_custkey as unit_id, c_mktsegment || '_' || (c_custkey % 2) as profile,
         substr(c_mktsegment, 1, 1) as technique,
         case when c_custkey % 2 = 0 then 'IDENT' else 'COMP' end as task,
         case when c_nationkey = 24 then null else c_nationkey % 4 end as condition_code,
         c_nationkey as participant_id
  from customer)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit_id"),
        F.concat_ws("_", "c_mktsegment", F.col("c_custkey") % 2).alias("profile"),
        F.substring("c_mktsegment", 1, 1).alias("technique"),
        F.when(F.col("c_custkey") % 2 == 0, "IDENT").otherwise("COMP").alias("task"),
        F.when(F.col("c_nationkey") != 24, F.col("c_nationkey") % 4).alias("condition_code"),
        F.col("c_nationkey").alias("participant_id"),
    )


# ----------------------------------------------------------------------------------------- images
IMAGE_FLAGS = {
    "mark_present": "case when o_orderkey % 17 <> 0 then 1 else 0 end",
    "presence_confidence": "(o_orderkey * 7919 % 1001) / 1024.0D",
    "x_eval": "case when o_orderkey % 19 <> 0 then 1 else 0 end",
    "y_eval": "case when o_orderkey % 23 <> 0 then 1 else 0 end",
    "x_present": "case when o_orderkey % 7 <> 0 then 1 else 0 end",
    "y_present": "case when o_orderkey % 11 <> 0 then 1 else 0 end",
    "needs_review": "case when o_orderstatus = 'P' then 1 else 0 end",
    "height": "(o_orderkey * 31 % 1000) / 1000.0D / 5.0D",
    "xbin": "(o_orderkey * 17 % 100) / 100.0D",
    "markers": "o_orderkey % 5",
    "xdisp": "(o_orderkey * 13 % 100) / 1000.0D",
    "ydisp": "(o_orderkey * 29 % 100) / 1000.0D",
}
IMAGE = (
    "image as (\n  select o_orderkey as filename, o_custkey as unit_id, profile, technique, task, condition_code, participant_id,\n         "
    + ",\n         ".join(f"{e.replace('.0D', '.0::double')} as {n}" for n, e in IMAGE_FLAGS.items())
    + "\n  from orders left join unit on o_custkey = unit_id)"
)
IMAGES = (UNIT, IMAGE)


def image_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per image without unit attributes: a pure scan."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("filename"),
        F.col("o_custkey").alias("unit_id"),
        *[F.expr(e).alias(n) for n, e in IMAGE_FLAGS.items()],
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Image facts with their unit attributes; broadcast or sort-merge is left to the optimizer."""
    return image_facts(spark, sf).join(units(spark, sf), "unit_id", "left")


# --------------------------------------------------------------------------------------- file names
FILE_NAME_EXPR = (
    "concat(case o_orderkey % 7 when 0 then 'BI' when 1 then 'BC' when 2 then 'LI' when 3 then 'LC' when 4 then 'SI' when 5 then 'SC' else 'xx' end, "
    "'_', lpad(cast(o_custkey % 400 as string), 3, '0'), '_R', lpad(cast(o_orderkey % 37 as string), 2, '0'), "
    "case o_orderkey % 5 when 0 then '.png' when 1 then '.jpg' when 2 then '.jpeg' when 3 then '.PNG' else '.gif' end)"
)


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.expr(FILE_NAME_EXPR).alias("filename"))


FILE_NAMES = f"files as (select o_orderkey, {FILE_NAME_EXPR.replace('as string', 'as varchar')} as filename from orders)"


# --------------------------------------------------------------------------------------- colours
def hex_of(c: str) -> str:
    return f"concat('#', upper(substr(md5(cast({c} as string)), 1, 6)))"


def hex_sql(c: str) -> str:
    return f"('#' || upper(substr(md5(cast({c} as varchar)), 1, 6)))"


# ----------------------------------------------------------------------------------------- tokens
TOKENS = """token as (
  select w, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) as w from documents) where w <> '' group by w)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct blank-separated tokens of all whole texts with their counts."""
    return (
        table(spark, sf, "documents")
        .select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("w"))
        .where("w <> ''")
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ------------------------------------------------------------------------------ derived descriptors
class Derived:
    """A descriptor table whose expressions read the same in both SQL dialects."""

    def __init__(self, name: str, source: str, exprs: dict[str, str], where: str | None = None):
        self.name, self.source, self.exprs, self.where = name, source, exprs, where

    def spark(self, spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, self.source)
        if self.where:
            df = df.where(self.where)
        return df.selectExpr(*[f"{e} as {n}" for n, e in self.exprs.items()])

    @property
    def cte(self) -> str:
        body = ", ".join(f"{e} as {n}" for n, e in self.exprs.items())
        return f"{self.name} as (select {body} from {self.source}" + (f" where {self.where}" if self.where else "") + ")"
