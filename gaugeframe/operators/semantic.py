"""Questions over small chart series, answered as aggregates, and their scoring.

A series has one row per category (year, sector, rate): ``k`` (text), ``ord`` (sort value), ``op`` and
``disb``.  All questions of a series are answered by one aggregation over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.text import norm_text, squeeze

# --- fixed values -------------------------------------------------------------------------------
YES, NO, NOT_SAME = "verdadeiro", "falso", "não"
NAMES = {"op": "Operação", "disb": "Desembolso"}
UP, DOWN = "↑", "↓"
# ------------------------------------------------------------------------------------------------


def money(v: Column) -> Column:
    """Rounded whole amount with dots between thousands."""
    return F.translate(F.format_number(F.rint(v), 0), ",", ".")


def yes_no(c: Column) -> Column:
    return F.when(c, YES).otherwise(NO)


def at(key: str, measure: str) -> Column:
    return F.max(F.when(F.col("k") == key, F.col(measure)))


def point(key: str, measure: str) -> Column:
    return money(at(key, measure))


def first_of(value: Column, order: Column) -> Column:
    """``value`` of the row with the least ``order``, the smallest value on ties; rows without order are passed over."""
    return F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]


def arg_max(measure: str) -> Column:
    return first_of(F.col("k"), -F.col(measure))


def arg_min(measure: str) -> Column:
    return first_of(F.col("k"), F.col(measure))


def is_greater(first: str, second: str, measure: str) -> Column:
    return yes_no(at(first, measure) > at(second, measure))


def larger_series(key: str) -> Column:
    return F.when(at(key, "op") >= at(key, "disb"), NAMES["op"]).otherwise(NAMES["disb"])


def op_above(key: str) -> Column:
    return yes_no(at(key, "op") > at(key, "disb"))


def largest_rise(measure: str) -> Column:
    """Interval of the largest consecutive rise; needs :func:`with_steps`."""
    return first_of(F.concat("prev_k", F.lit("–"), "k"), -F.col(f"rise_{measure}"))


def maxima() -> Column:
    return F.concat(*[x for m in ("op", "disb") for x in (F.lit(("; " if m == "disb" else "") + NAMES[m] + "="), arg_max(m))])


def arg_max_gap(signed: bool = False) -> Column:
    gap = F.col("op") - F.col("disb")
    return first_of(F.col("k"), -(gap if signed else F.abs(gap)))


def same_direction(first: str, second: str) -> Column:
    """``verdadeiro`` when both measures move alike, else ``não`` with an arrow per measure."""

    def up(m: str) -> Column:
        return at(second, m) > at(first, m)

    def arrow(m: str) -> Column:
        return F.concat(F.lit(NAMES[m] + " "), F.when(up(m), UP).otherwise(DOWN))

    return F.when(up("op") == up("disb"), YES).otherwise(F.concat(F.lit(NOT_SAME + "; "), arrow("op"), F.lit("; "), arrow("disb")))


def ranking(measure: str, keys: list[str] | None = None) -> Column:
    """Categories by descending value; the list holds one entry per category of the chart."""
    row = F.struct((-F.col(measure)).alias("v"), F.col("k"))
    rows = row if keys is None else F.when(F.col("k").isin(keys), row)
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["k"]), " > ")


def above(measure: str, limit: float) -> Column:
    rows = F.when(F.col(measure) > limit, F.struct((-F.col(measure)).alias("v"), F.col("k")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["k"]), ", ")


def best_among(measure: str, cond: str) -> Column:
    return first_of(F.col("k"), F.when(F.expr(cond), -F.col(measure)))


def largest_key() -> Column:
    return F.max_by("k", "ord")


def for_all() -> Column:
    return yes_no(F.bool_and(F.col("op") > F.col("disb")))


def exists() -> Column:
    return yes_no(F.bool_or(F.col("op") > F.col("disb")))


def with_steps(series: DataFrame) -> DataFrame:
    """Change against the category before; a series has one row per category, so one window is small."""
    w = Window.partitionBy(F.lit(1)).orderBy("ord")
    return series.withColumns({"prev_k": F.lag("k").over(w), "rise_op": F.col("op") - F.lag("op").over(w), "rise_disb": F.col("disb") - F.lag("disb").over(w)})


def answer(series: DataFrame, questions: dict[str, Column]) -> DataFrame:
    """``profile, id, answer`` rows of all questions of one series in one pass."""
    row = series.agg(*[c.cast("string").alias(q) for q, c in questions.items()])
    pairs = ", ".join(f"'{q}', `{q}`" for q in questions)
    return row.selectExpr(f"stack({len(questions)}, {pairs}) as (id, answer)").select(F.substring("id", 1, 2).alias("profile"), "id", "answer")


def compare_answers(given: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact match after case, accent and blank normalisation; a missing answer does not match."""
    plain = lambda c: squeeze(norm_text(F.coalesce(F.col(c), F.lit(""))))
    j = truth.select("profile", "id", F.col("answer").alias("expected")).join(given.select("id", "answer"), "id", "left")
    return j.withColumn("is_match", (plain("expected") == plain("answer")).cast("int"))
