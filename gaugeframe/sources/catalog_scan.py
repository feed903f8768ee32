"""Scoring and tagging of candidate result tables by their columns and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import count_where

# --- fixed values -------------------------------------------------------------------------------
ROW_TIERS = [(3000, 12), (1000, 8), (500, 5)]
FILE_TIERS = [(3000, 15), (1000, 8), (500, 4)]
NAME_HINT = r"chart.?type|techni|classif|multiclass|exclusive|stem"
SEARCH_NAME = r"(?i)(techni|technique|classific|chart[_-]?type|tipo[_-]?graf|bar[_-]?line|stem|scatter)"
STRONG_BASE, TOKEN_POINTS, NAME_POINTS = 10, 5, 3
# ------------------------------------------------------------------------------------------------


def _tier(c: Column, tiers: list[tuple[int, int]]) -> Column:
    out = F.when(c >= tiers[0][0], tiers[0][1])
    for limit, points in tiers[1:]:
        out = out.when(c >= limit, points)
    return out.otherwise(0)


def profile_score(tables: dict[str, tuple[DataFrame, str, str, str]], strong: list[str], words: list[str]) -> DataFrame:
    """Score of every candidate table: strong columns, size, distinct files, class words, name.

    ``tables``: name -> (frame, file column, profile column, text column).  Each table is one
    aggregate scan; only its one-row summary is unioned.
    """
    parts = []
    for name, (df, file_col, profile_col, text_col) in tables.items():
        hits = sorted(set(strong) & {c.lower() for c in df.columns})
        parts.append(
            df.agg(
                F.lit(name).alias("name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_distinct(file_col).alias("n_unique_filename"),
                F.array_join(F.array_sort(F.collect_set(F.col(profile_col).cast("string"))), "|").alias("profiles"),
                F.lit("|".join(hits)).alias("strong_columns"),
                F.lit(len(hits)).alias("n_strong"),
                *[count_where(F.upper(text_col).rlike(rf"\b{w}\b")).alias(f"n_{w.lower()}") for w in words],
            )
        )
    t = reduce(lambda a, b: a.unionByName(b), parts)
    found = reduce(lambda a, b: a + b, [F.col(f"n_{w.lower()}") for w in words])
    score = (
        F.when(F.col("n_strong") > 0, STRONG_BASE + F.col("n_strong")).otherwise(0)
        + _tier(F.col("n_rows"), ROW_TIERS)
        + _tier(F.col("n_unique_filename"), FILE_TIERS)
        + F.when(found > 0, TOKEN_POINTS).otherwise(0)
        + F.when(F.lower("name").rlike(NAME_HINT), NAME_POINTS).otherwise(0)
    )
    return t.withColumn("score", score.cast("int")).drop("n_strong").orderBy(F.desc("score"), "name")


def kind_tags(columns: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Kinds of every table from rules over its header set.

    ``columns``: name, cols (array of lower-case column names); a table needs ``filename``.
    """
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    has_key = F.array_contains("cols", "filename")
    return columns.select("name", F.when(has_key, F.array_join(hits, "|")).otherwise("").alias("kinds"))


def has_any(*names: str) -> Column:
    return F.arrays_overlap("cols", F.array(*[F.lit(n) for n in names]))


def search_score(columns: DataFrame, wanted: list[str]) -> DataFrame:
    """+2 name, +5 wanted columns, +3 technique with a result column; candidates need two points."""
    s = (
        F.when(F.col("name").rlike(SEARCH_NAME), 2).otherwise(0)
        + F.when(has_any(*wanted), 5).otherwise(0)
        + F.when(F.array_contains("cols", "technique") & has_any("prediction", "classification", "detected", "observed"), 3).otherwise(0)
    )
    return columns.select("name", s.alias("search_score")).where("search_score >= 2")
