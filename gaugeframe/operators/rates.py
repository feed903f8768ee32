"""Counts and rates with conditional denominators; repeated group-bys share one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import count_where, fixed_rows, percentile, ratio, rint_round
from gaugeframe.functions.status import C, NC, U, U_SPEC


def status_counts(df: DataFrame, col: str, default: str | None = None) -> DataFrame:
    c = F.col(col) if default is None else F.coalesce(F.col(col), F.lit(default))
    return df.groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Measures:
    """Additive row measures and the ratios formed from their sums.

    Because every measure is a sum, a large fact table is first summed per unit (map-side combine,
    one shuffle) and only those sums meet the dimension and the grouping sets.
    """

    adds: dict[str, Column]
    ratios: dict[str, Column] = field(default_factory=dict)
    helpers: tuple[str, ...] = ()

    def partial(self, facts: DataFrame, *keys: str) -> DataFrame:
        return facts.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in self.adds.items()])

    def _sums(self) -> list[Column]:
        return [F.sum(n).alias(n) for n in self.adds]

    def finish(self, sums: DataFrame) -> DataFrame:
        return sums.withColumns(self.ratios).drop(*self.helpers)

    def by(self, partials: DataFrame, *keys: str) -> DataFrame:
        return self.finish(partials.groupBy(*keys).agg(*self._sums()))

    def by_sets(self, partials: DataFrame, sets: list[list[str]]) -> DataFrame:
        return self.finish(grouped_sets(partials, sets, self._sums()))


def _one(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def mark_measures() -> Measures:
    p, c = F.col("mark_present"), F.col("presence_confidence")
    judged = F.col("n_mark_present") + F.col("n_mark_absent")
    return Measures(
        {
            "n_images": F.lit(1).cast("bigint"),
            "n_mark_present": _one(p == 1),
            "n_mark_absent": _one(p == 0),
            "__conf": c,
            "__n": _one(c.isNotNull()),
        },
        {
            "p_mark_present": ratio(F.col("n_mark_present"), judged),
            "p_mark_absent": ratio(F.col("n_mark_absent"), judged),
            "presence_confidence_mean": ratio(F.col("__conf"), F.col("__n")),
        },
        ("__conf", "__n"),
    )


def mark_units(facts: DataFrame, key: str) -> DataFrame:
    """Per-unit presence counts and rates with the spread of the confidence."""
    m, c = mark_measures(), F.col("presence_confidence")
    sums = facts.groupBy(key).agg(
        *[F.sum(x).alias(n) for n, x in m.adds.items()],
        rint_round(percentile(c, 0.5)).alias("presence_confidence_median"),
        F.min(c).alias("presence_confidence_min"),
    )
    return m.finish(sums)


def axis_measures() -> Measures:
    """Each rate counts only the images in which that axis could be judged."""
    x, y = F.col("x_eval") == 1, F.col("y_eval") == 1
    px, py = F.col("x_present") == 1, F.col("y_present") == 1
    parts = {"x": (x, px), "y": (y, py), "both": (x & y, px & py)}
    adds, ratios = {"n_images": F.lit(1).cast("bigint")}, {}
    for name, (can, has) in parts.items():
        adds[f"n_{name}_evaluable"] = _one(can)
        adds[f"n_{name}_present"] = _one(can & has)
        ratios[f"p_{name}_present"] = ratio(F.col(f"n_{name}_present"), F.col(f"n_{name}_evaluable"))
    adds["n_unevaluable"] = _one(~(x & y))
    return Measures(adds, ratios)


def label_measures() -> Measures:
    px, py = F.col("x_present") == 1, F.col("y_present") == 1
    both = px & py & (F.col("x_eval") == 1) & (F.col("y_eval") == 1)
    shares = {"x_present": px, "y_present": py, "both_present": both}
    adds = {"n_images": F.lit(1).cast("bigint")}
    adds |= {f"n_{k}": _one(v) for k, v in shares.items()}
    adds |= {"n_review": _one(F.col("needs_review") == 1), "n_x_seg_ok": _one(F.col("x_eval") == 1), "n_y_seg_ok": _one(F.col("y_eval") == 1)}
    ratios = {f"pct_{k}": rint_round(100 * F.col(f"n_{k}") / F.col("n_images")) for k in shares}
    return Measures(adds, ratios)


def all_repeats(units: DataFrame) -> DataFrame:
    """Flags for units in which every repeat shows the labels."""
    return units.withColumns({f"all_{k}": (F.col(f"n_{k}") == F.col("n_images")).cast("int") for k in ("x_present", "y_present", "both_present")})


def grouped_sets(df: DataFrame, sets: list[list[str]], measures: list[Column], level: str = "level") -> DataFrame:
    """Several group-bys in one job; a NULL key value stays a group of its own.

    ``level`` names the grouping, since NULL cannot tell "all" from "missing".
    """
    cols = list(dict.fromkeys(c for s in sets for c in s))
    total = len(cols)

    def mask(s: list[str]) -> int:
        return sum(1 << (total - 1 - i) for i, c in enumerate(cols) if c not in s)

    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("__g"), *measures)
    names = F.create_map(*[F.lit(x) for s in sets for x in (mask(s), "+".join(s))])
    return out.withColumn(level, F.element_at(names, F.col("__g").cast("int"))).drop("__g")


def evaluable_rates(df: DataFrame, key: str, status: str) -> DataFrame:
    """Counts per outcome and the conforming share among judged rows."""
    s = F.col(status)
    good, bad = count_where(s == C), count_where(s == NC)
    return df.groupBy(key).agg(
        good.alias("n_conforming"),
        bad.alias("n_nonconforming"),
        count_where(s == U).alias("n_unevaluable"),
        count_where(s == U_SPEC).alias("n_spec_conflict"),
        ratio(good, good + bad).alias("rate_evaluable"),
    )


def confusion(df: DataFrame, row: str, col: str, classes: list[str]) -> DataFrame:
    """Fixed classes on both sides, zero cells kept, with row totals."""
    cells = df.groupBy(F.col(row).alias("manual")).agg(*[count_where(F.col(col) == c).alias(c) for c in classes])
    frame = fixed_rows(df.sparkSession, "manual", classes)
    full = frame.join(cells, "manual", "left").na.fill(0)
    return full.withColumn("TOTAL", sum((F.col(c) for c in classes), F.lit(0).cast("bigint")))


def accuracy(df: DataFrame, match: str) -> DataFrame:
    ok, no = count_where(F.col(match) == "MATCH"), count_where(F.col(match) == "MISMATCH")
    return df.agg(
        ok.alias("n_match"),
        no.alias("n_mismatch"),
        count_where(F.col(match) == U).alias("n_unevaluable"),
        F.coalesce(ratio(ok, ok + no), F.lit(0.0)).alias("accuracy"),
    )


def zero_failure_bound(df: DataFrame, failed: Column) -> DataFrame:
    """One-sided 95% upper bound of the failure rate, defined when nothing failed."""
    n, k = F.count(F.lit(1)), count_where(failed)
    return df.agg(n.alias("n"), k.alias("n_failed"), F.when(k == 0, rint_round(1 - F.pow(F.lit(0.05), 1 / n))).alias("upper_bound"))


def observed_by(df: DataFrame, key: str, col: str, classes: list[str]) -> DataFrame:
    """Class counts per key and overall (key NULL -> ``ALL``) in one pass."""
    counts = [count_where(F.col(col) == c).alias(c) for c in classes]
    out = df.rollup(key).agg(F.grouping(key).alias("__g"), *counts)
    return out.withColumn(key, F.when(F.col("__g") == 1, "ALL").otherwise(F.col(key))).drop("__g")


def row_shares(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Cross table with counts and row percentages."""
    n = F.count(F.lit(1))
    return df.groupBy(row).agg(
        *[count_where(F.col(col) == v).alias(f"n_{v}") for v in values],
        *[rint_round(100 * count_where(F.col(col) == v) / n).alias(f"pct_{v}") for v in values],
    )


def balance(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Groups whose size differs from the design."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
