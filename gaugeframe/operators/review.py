"""Tables handed to and taken back from human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_projection(df: DataFrame, preferred: list[str], blank: list[str]) -> DataFrame:
    """Preferred columns that exist, followed by empty columns for the reviewer."""
    return df.select(*[c for c in preferred if c in df.columns], *[F.lit(None).cast("string").alias(b) for b in blank])


def overlay(auto: DataFrame, manual: DataFrame, key: str, auto_col: str, manual_col: str, out: str = "final_status") -> DataFrame:
    """Manual result where one exists, automatic result elsewhere, with the source named."""
    joined = auto.join(manual.select(key, manual_col), key, "left")
    return joined.withColumns({
        out: F.coalesce(F.col(manual_col), F.col(auto_col)),
        "decision_source": F.when(F.col(manual_col).isNotNull(), "MANUAL").otherwise("AUTO"),
    })


def review_queue(df: DataFrame, condition: Column, keep: list[str], blank: list[str], order: str) -> DataFrame:
    return audit_projection(df.where(condition), keep, blank).orderBy(order)
