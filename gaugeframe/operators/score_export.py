"""Similarity scores: per-participant means and pivots with the rounding order of the export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import rint_round


def participant_summary(scores: DataFrame) -> DataFrame:
    """Rows are rounded to two digits first, then averaged (NULL scores are skipped).

    The mean is taken over whole hundredths, which add up exactly in any order.
    """
    means = [(F.avg(F.rint(F.col(c) * 100.0)) / 100.0).alias(c) for c in ("ocr", "clip")]
    return scores.groupBy("participant", "condition", "task").agg(*means)


def score_pivot(summary: DataFrame, score: str, conditions: list[str], tasks: list[str]) -> DataFrame:
    """One row per participant, one column per condition and task, rounded again."""
    keyed = summary.withColumn("__col", F.concat_ws("_", "condition", "task"))
    wide = keyed.groupBy("participant").pivot("__col", [f"{c}_{t}" for c in conditions for t in tasks]).agg(F.avg(score))
    return wide.select("participant", *[rint_round(F.col(f"`{c}`"), 2).alias(c) for c in wide.columns if c != "participant"])


def export_bundle(scores: DataFrame, conditions: list[str], tasks: list[str]) -> dict[str, DataFrame]:
    """The four export tables: OCR pivot, CLIP pivot, long rows and means."""
    summary = participant_summary(scores)
    return {
        "ocr": score_pivot(summary, "ocr", conditions, tasks),
        "clip": score_pivot(summary, "clip", conditions, tasks),
        "rows": scores.withColumns({c: rint_round(F.col(c), 2) for c in ("ocr", "clip")}),
        "summary": summary,
    }
