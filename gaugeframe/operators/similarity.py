"""Component texts of an image, their comparison with a reference and the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.similarity import cosine, list_similarity, text_similarity

# --- fixed values -------------------------------------------------------------------------------
TITLE_MAX_Y, LEGEND_MIN_X, CATEGORY_MIN_Y, CATEGORY_MIN_LENGTH = 0.05, 0.85, 0.90, 5
LEGEND_TITLE, AXIS_WORD, MONEY = "nomes das medidas", "setor", r"R\$\s*[\d,.]+"
COMPARE_VALUES = {"B-COMP": True, "B-ID": True, "L-COMP": False, "L-ID": True, "P-COMP": False, "P-ID": False}
# ------------------------------------------------------------------------------------------------
LISTS = ["legend", "categories", "values"]


def components(tokens: DataFrame, key: str, images: DataFrame | None = None) -> DataFrame:
    """Title, legend, categories, values and axis title of every image in one aggregation.

    ``tokens``: key, pos (reading order), text, x, x_norm, y_norm.  Tokens that belong to no
    component are dropped before the shuffle.  ``images`` names the images, so that those whose tokens
    match nothing have (empty) components; without it they are found by reading the tokens again.
    """
    text, low = F.col("text"), F.lower("text")
    is_title = F.col("y_norm") < TITLE_MAX_Y
    is_legend = (F.col("x_norm") > LEGEND_MIN_X) & (low != LEGEND_TITLE)
    has_axis = low.contains(AXIS_WORD)
    is_category = (F.col("y_norm") >= CATEGORY_MIN_Y) & ~has_axis & ~text.contains("R$") & ~text.rlike(r"\d") & (F.length(text) >= CATEGORY_MIN_LENGTH)
    is_value = text.rlike(MONEY)
    kept = tokens.where(is_title | is_legend | has_axis | is_category | is_value)

    def listing(cond: Column, *order: str) -> Column:
        row = F.when(cond, F.struct(*[F.col(o) for o in order], text.alias("__t")))
        return F.transform(F.array_sort(F.collect_list(row)), lambda s: s["__t"])

    parts = kept.groupBy(key).agg(
        F.trim(F.array_join(listing(is_title, "x", "pos"), " ")).alias("title"),
        listing(is_legend, "pos").alias("legend"),
        listing(is_category, "x", "pos").alias("categories"),
        listing(is_value, "pos").alias("values"),
        F.coalesce(F.min_by(F.when(has_axis, text), F.when(has_axis, F.col("pos"))), F.lit("")).alias("x_axis"),
    )
    out = (tokens if images is None else images).select(key).distinct().join(parts, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS})
    return out.na.fill("", ["title", "x_axis"])


def text_scores(generated: DataFrame, reference: DataFrame, task: str) -> DataFrame:
    """Component similarities with the task's reference and their mean.

    ``reference`` has one row per task and a ``compare_values`` flag; both carry the columns of
    :func:`components`.
    """
    fields = ["title", "x_axis", *LISTS]
    ref = reference.select(task, "compare_values", *[F.col(f).alias(f"ref_{f}") for f in fields])
    j = generated.join(ref, task)
    sims = {f"s_{f}": text_similarity(F.col(f"ref_{f}"), F.col(f)) for f in ("title", "x_axis")}
    sims |= {f"s_{f}": list_similarity(F.col(f"ref_{f}"), F.col(f)) for f in LISTS}
    j = j.withColumns(sims).withColumn("s_values", F.when(F.col("compare_values"), F.col("s_values")))
    base = F.col("s_title") + F.col("s_x_axis") + F.col("s_legend") + F.col("s_categories")
    score = F.when(F.col("compare_values"), (base + F.col("s_values")) / 5).otherwise(base / 4)
    return j.withColumn("ocr", score).drop("compare_values", *[f"ref_{f}" for f in fields])


def vector_scores(vectors: DataFrame, key: str, task: str, vector: str) -> DataFrame:
    """Cosine of every vector with the reference of its task (lowest key), the reference left out."""
    ref = vectors.groupBy(task).agg(F.min_by(F.struct(F.col(key).alias("ref_key"), F.col(vector).alias("ref_vector")), key).alias("r"))
    j = vectors.join(ref.select(task, "r.*"), task).where(F.col(key) != F.col("ref_key"))
    return j.select(key, task, "ref_key", cosine(F.col(vector), F.col("ref_vector")).alias("clip"))


def score_long(images: DataFrame, ocr: DataFrame, clip: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """One row per image; a failed image keeps its error text and has no scores."""
    j = images.join(ocr, key, "left").join(clip, key, "left").join(errors, key, "left")
    ok = F.col("error").isNull()
    return j.select(
        *[c for c in images.columns],
        F.replace("image", F.lit(".png"), F.lit("")).alias("trial"),
        F.when(ok, F.col("ocr")).alias("ocr"),
        F.when(ok, F.col("clip")).alias("clip"),
        F.coalesce("error", F.lit("OK")).alias("status"),
    )
