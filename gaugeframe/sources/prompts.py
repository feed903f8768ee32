"""Prompt records: validation with a reason per reject, and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.text import basename

# --- fixed values -------------------------------------------------------------------------------
UNIT_ID = r"^(BI|BC|LI|LC|SI|SC)_\d{3}$"
IMAGE_FILE = r"(?i)^(BI|BC|LI|LC|SI|SC)_\d{3}_R\d{2}\.(png|jpg|jpeg)$"
# ------------------------------------------------------------------------------------------------


def validate_prompts(records: DataFrame) -> DataFrame:
    """First broken rule per record in ``reject_reason`` (NULL = valid)."""
    counts = records.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_same"))
    names = F.transform(F.coalesce("images", F.array().cast("array<string>")), basename)
    r = records.join(counts, "unit_id").withColumn("names", names)
    unit, files = F.col("unit_id"), F.col("names")
    file_name = basename(F.coalesce("prompt_file", F.lit("")))
    reason = (
        F.when(~unit.rlike(UNIT_ID), "BAD_UNIT_ID")
        .when(F.col("prompt_text").isNull(), "NO_PROMPT")
        .when((file_name != "") & (file_name != F.concat(unit, F.lit(".txt"))), "PROMPT_FILE_MISMATCH")
        .when(~F.forall(files, lambda s: s.rlike(IMAGE_FILE)), "BAD_IMAGE_NAME")
        .when(~F.forall(files, lambda s: F.upper(F.substring(s, 1, 6)) == unit), "IMAGE_OF_OTHER_UNIT")
        .when(F.size(F.array_distinct(F.transform(files, lambda s: F.substring(s, 9, 2)))) < F.size(files), "DUPLICATE_REPEAT")
        .when(F.col("n_same") > 1, "DUPLICATE_UNIT")
    )
    return r.withColumn("reject_reason", reason).drop("names", "n_same")


def prompt_manifest(records: DataFrame, keep: list[str]) -> DataFrame:
    names = F.transform(F.col("images"), basename)
    return records.select(
        *keep,
        "unit_id",
        F.concat("unit_id", F.lit(".txt")).alias("prompt_file"),
        F.size(names).alias("n_images"),
        F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("first_image"),
        F.coalesce(F.get(names, F.size(names) - 1), F.lit("")).alias("last_image"),
        F.sha2("prompt_text", 256).alias("prompt_sha256"),
    )
