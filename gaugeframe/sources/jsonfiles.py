"""JSON inputs: line records with rejects, nested question files, colour configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.integrate import require_empty


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Valid records with their source line, and rejected lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.trim("value").rlike(r"^\{.*\}$").alias("is_object"))
    whole = F.from_json(F.col("value"), "map<string,string>").isNotNull()
    ok = F.col("is_object") & whole & F.col("r").isNotNull()
    return parsed.where(ok).select("r.*", F.col("value").alias("source_line")), parsed.where(~ok).select(F.col("value").alias("source_line"))


def read_profile_json(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """``{profile: [{id, pergunta, resposta}]}`` to one row per question.

    A question file is one document; ``one_per_line`` reads files with a document on every line.
    """
    doc = spark.read.text(path, wholetext=not one_per_line)
    m = F.from_json("value", "map<string,array<struct<id:string,pergunta:string,resposta:string>>>")
    return doc.select(F.explode(m).alias("profile", "qs")).select("profile", F.explode("qs").alias("q")).select("profile", "q.*")


def read_color_config(spark: SparkSession, path: str, profiles: list[str]) -> DataFrame:
    """Expected colours per profile with their hex; unknown names or absent profiles are errors."""
    doc = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "palette_F map<string,string>, expected_colors_by_profile map<string,array<string>>").alias("c")
    )
    palette = doc.select(F.explode("c.palette_F").alias("color_name", "hex"))
    wanted = doc.select(F.explode("c.expected_colors_by_profile").alias("profile", "names")).select("profile", F.posexplode("names").alias("idx", "color_name"))
    named = wanted.join(palette, "color_name", "left")
    require_empty(named.where("hex is null").select("profile", "color_name"), "colours outside the palette")
    missing = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in profiles])).alias("profile")).join(wanted.select("profile").distinct(), "profile", "left_anti")
    require_empty(missing, "profiles without expected colours")
    return named.select("profile", "idx", "color_name", "hex")
