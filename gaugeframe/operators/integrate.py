"""Key and coverage checks, lookups and the per-item integration of all result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.text import pad_condition


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once (must be empty where a key has to be unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_empty(df: DataFrame, what: str, show: int = 10) -> None:
    """Raise with a few examples when a violation table has rows; reads no more than ``show`` rows."""
    bad = df.limit(show).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")


def missing_from(universe: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Universe keys that a source lacks, one row per (source, key)."""
    parts = [
        universe.select(key).join(src.select(key), key, "left_anti").select(F.lit(name).alias("source"), key)
        for name, src in sources.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach(facts: DataFrame, dim: DataFrame, key, optional: list[str]) -> DataFrame:
    """Left join of the optional columns a dimension really has.

    No hint: the optimizer broadcasts the dimension when its measured size allows it and
    sort-merges (with skew splitting) when it does not.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return facts.join(dim.select(*keys, *[c for c in optional if c in dim.columns]), keys, "left")


def crosswalk(dim: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Resolve column aliases, keep one row per unit and pad the condition code."""
    cols = {}
    for name, options in aliases.items():
        hit = next((c for c in options if c in dim.columns), None)
        if hit is not None:
            cols[name] = F.col(hit)
    out = dim.select(*[c.alias(n) for n, c in cols.items()])
    if "condition_code" in cols:
        out = out.withColumn("condition_code", pad_condition(F.col("condition_code")))
    rest = [c for c in out.columns if c != "unit_id"]
    # one deterministic row per unit with a map-side combine
    return out.groupBy("unit_id").agg(F.min(F.struct(*rest)).alias("r")).select("unit_id", "r.*")


def integration_faults(universe: DataFrame, sources: dict[str, DataFrame], review: DataFrame, key: str) -> DataFrame:
    """Keys that would be lost or multiplied: not exactly once in the universe and in every source, or
    more than once reviewed. One counting pass over the keys of all tables."""
    frames = {"universe": universe, **sources, "review": review}
    rows = None
    for name, df in frames.items():
        own = df.select(key, *[F.lit(int(n == name)).alias(f"n_{n}") for n in frames])
        rows = own if rows is None else rows.unionByName(own)
    counts = rows.groupBy(key).agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in frames])
    bad = F.col("n_review") > 1
    for name in ("universe", *sources):
        bad = bad | (F.col(f"n_{name}") != 1)
    # a review of something outside the universe changes no result
    return counts.where(bad & (sum((F.col(f"n_{n}") for n in ("universe", *sources)), F.lit(0)) > 0))


def integrate(universe: DataFrame, sources: dict[str, DataFrame], review: DataFrame, key: str, guard: bool = True) -> DataFrame:
    """Universe joined 1:1 with every source and left-joined with the review table.

    With ``guard`` a key that is doubled or missing anywhere is an error; without it, such keys are
    multiplied or dropped by the joins.
    """
    if guard:
        require_empty(integration_faults(universe, sources, review, key), "keys doubled or missing")
    out = universe
    for src in sources.values():
        out = out.join(src, key)
    return out.join(review, key, "left")


def golden_checks(counts: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Expected counts next to the found ones with a pass flag; a missing count is zero."""
    j = expected.join(counts, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("bigint")))
    return j.withColumn("ok", F.col(value) == F.col(f"expected_{value}"))
