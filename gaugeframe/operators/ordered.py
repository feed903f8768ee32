"""Ordered operators: runs, gaps, islands, covers and groups around a moving centre.

Skew: an image can hold any number of rows, so every operator first reduces rows per (image,
position) with a map-side combine.  Where positions live on a pixel, degree or bin grid, that bounds what
one window group can hold whatever the number of rows; groups around a centre have no such bound and
are folded over parts of an image.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.numbers import percentile, rint_round, sorted_quantile
from gaugeframe.operators.fold import fold_groups


def _ordered(key: str | list[str], *order) -> Window:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(*order)


def island_ids(df: DataFrame, key, start: str, breaks: Column, out: str = "island") -> DataFrame:
    """Running number of breaks along ``start`` within ``key``."""
    w = _ordered(key, start)
    return df.withColumn(out, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


# ------------------------------------------------------------------------------------- simple runs
def consecutive_distinct(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Drop a value equal to the one before it in spatial order.

    Equal values at one position are adjacent, so rows are made distinct before they are ordered.
    """
    before = F.lag(value).over(_ordered(key, order, value))
    return df.select(key, order, value).distinct().withColumn("__p", before).where(~F.col("__p").eqNullSafe(F.col(value)) | F.col("__p").isNull()).drop("__p")


def monotone(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """1/0 when the values never decrease along ``order``, NULL with fewer than two.

    Ties in ``order`` are ordered by value, so only strictly increasing positions can break it:
    the largest value of a position must not exceed the smallest of the next one.
    """
    d = df.groupBy(key, order).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    d = d.withColumn("ok", F.coalesce(F.col("lo") >= F.lag("hi").over(_ordered(key, order)), F.lit(True)))
    return d.groupBy(key).agg(
        F.sum("n").alias("n_values"),
        F.when(F.sum("n") >= 2, F.min(F.col("ok").cast("int"))).alias("monotone"),
    )


def ordered_concat(df: DataFrame, key: str, order: list[str], text: str, sep: str = " ") -> DataFrame:
    """Texts of an image joined in spatial order; the result is the row, so it holds the whole text."""
    items = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda s: s[text]), sep).alias("text"))


# ---------------------------------------------------------------------------------- hue, lanes, bins
def hue_families(markers: DataFrame, key: str, hue: str, weight: str, link: float = 25.0, bin_width: float = 1.0) -> DataFrame:
    """Single-link families on the hue circle: a gap above ``link`` splits, 360 wraps to 0.

    Markers are summed per one-degree bin first: two hues in one bin are never further apart than
    ``link``, so a bin only needs its smallest and largest hue and its weighted sine and cosine.
    The windows therefore see at most 360 rows per image.
    """
    rad = F.radians(hue)
    w = F.greatest(F.col(weight), F.lit(1))
    bins = markers.groupBy(key, F.floor(F.col(hue) / bin_width).alias("bin")).agg(
        F.min(hue).alias("lo"), F.max(hue).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.sum(w * F.sin(rad)).alias("sy"), F.sum(w * F.cos(rad)).alias("cx"),
    )
    everything = Window.partitionBy(key)
    gap = F.col("lo") - F.lag("hi").over(_ordered(key, "bin"))
    d = island_ids(bins.withColumn("gap", gap), key, "bin", F.col("gap") > link)
    d = d.withColumns({
        "last": F.max("island").over(everything),
        "wraps": (F.min("lo").over(everything) + 360.0 - F.max("hi").over(everything)) <= link,
    })
    family = F.when(F.col("wraps") & (F.col("island") == F.col("last")), 0).otherwise(F.col("island"))
    g = d.groupBy(key, family.alias("family")).agg(F.sum("n").alias("n_markers"), F.sum("sy").alias("sy"), F.sum("cx").alias("cx"))
    mean = F.pmod(F.degrees(F.atan2("sy", "cx")) + 360.0, F.lit(360.0))
    g = g.withColumn("family_hue", rint_round(mean, 4))
    rank = F.row_number().over(_ordered(key, "family_hue", "n_markers"))
    return g.withColumn("family_rank", rank.cast("bigint")).drop("sy", "cx", "family")


def lane_groups(bins: DataFrame, key: str, bin_col: str, n_bins: int, bin_width: int, length: int) -> DataFrame:
    """Groups of occupied bins in which one empty bin per uninterrupted run may be bridged.

    A run of occupied bins always resets the allowance, so an empty stretch of exactly one bin is
    bridged and a longer one splits: plain islands with ``next - previous <= 2``.
    """
    d = bins.select(key, bin_col).distinct()
    w = _ordered(key, bin_col)
    d = island_ids(d, key, bin_col, F.col(bin_col) - F.lag(bin_col).over(w) > 2)
    per = d.groupBy(key, "island").agg(F.min(bin_col).alias("a"), F.max(bin_col).alias("b"), F.count(F.lit(1)).alias("n"))
    right = F.least(F.lit(length - 1), (F.col("b") + 1) * bin_width - 1)
    center = (F.col("a") * bin_width + right) / 2
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_groups"),
        rint_round((F.max(center) - F.min(center)) / max(1, length - 1)).alias("span"),
        F.sum("n").alias("occupied_bins"),
        rint_round((F.max("b") - F.min("a") + 1) / n_bins).alias("extent"),
        rint_round(F.sum("n") / n_bins).alias("occupied_ratio"),
    )


def bin_union_support(segments: DataFrame, key: str, first: str, last: str, n_bins: int) -> DataFrame:
    """Share of bins covered by any segment."""
    spans = segments.select(key, first, last).distinct()
    cells = spans.select(key, F.explode(F.sequence(first, last)).alias("bin"))
    return cells.groupBy(key).agg(rint_round(F.count_distinct("bin") / n_bins).alias("support"))


def interval_union(intervals: DataFrame, key, start: str, end: str, canvas: float, adjacent: int = 1) -> DataFrame:
    """Covered length of overlapping or adjacent pixel intervals and its share of the canvas.

    Only the longest interval per start pixel can matter, so at most one row per pixel is ordered.
    """
    keys = [key] if isinstance(key, str) else key
    d = intervals.groupBy(*keys, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("__n"))
    seen = F.max(end).over(_ordered(keys, start).rowsBetween(Window.unboundedPreceding, -1))
    d = island_ids(d.withColumn("__seen", seen), keys, start, F.col(start) > F.col("__seen") + adjacent)
    per = d.groupBy(*keys, "island").agg(F.min(start).alias("a"), F.max(end).alias("b"), F.sum("__n").alias("n"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n_segments"),
        F.count(F.lit(1)).alias("n_islands"),
        F.min("a").alias("first"),
        F.max("b").alias("last"),
        F.sum(F.col("b") - F.col("a") + 1).alias("covered"),
        rint_round(F.sum(F.col("b") - F.col("a") + 1) / canvas).alias("coverage"),
    )


def gap_scale_groups(df: DataFrame, key: str, pos: str, ratio_min: float = 2.2) -> DataFrame:
    """Centres joined when their gaps show two scales, else left alone; group means.

    Two or fewer centres stay as they are; equal positions count as gaps of zero.
    """
    d = df.groupBy(key, pos).agg(F.count(F.lit(1)).alias("m"))
    w, everything = _ordered(key, pos), Window.partitionBy(key)
    d = d.withColumn("gap", F.col(pos) - F.lag(pos).over(w))
    real = F.when(F.col("gap") > 1, F.col("gap"))
    d = d.withColumns({"lo": F.min(real).over(everything), "hi": F.max(real).over(everything), "n": F.sum("m").over(everything)})
    two_scales = (F.col("n") > 2) & (F.col("hi") / F.greatest(F.lit(1.0), F.col("lo")) >= ratio_min)
    flat = (F.col("n") > 2) & F.col("lo").isNull()
    join_next = flat | (two_scales & (F.col("gap") <= F.sqrt(F.col("lo") * F.col("hi"))))
    d = d.withColumn("merges", F.coalesce(two_scales, F.lit(False)) | flat)
    d = island_ids(d, key, pos, ~F.coalesce(join_next, F.lit(False)))
    # without joining, every single centre is a group, also equal ones
    single = d.where("not merges").select(key, F.col(pos).alias("center"), F.explode(F.array_repeat(F.lit(1).cast("bigint"), F.col("m").cast("int"))).alias("n_members"))
    merged = d.where("merges").groupBy(key, "island").agg((F.sum(F.col(pos) * F.col("m")) / F.sum("m")).alias("center"), F.sum("m").alias("n_members"))
    return single.unionByName(merged.drop("island"))


# --------------------------------------------------------------------------- groups around a centre
class CenterGroups:
    """The open group around a running weighted mean: what to add, and when it is too far."""

    #: rows of each key that are taken together with those of all other keys
    STEPS = 64

    def __init__(self, tol: float):
        self.facts, self.tol, self.n = (tol,), tol, 0

    def add(self, p: float, w: float, m: int, labels: list[str]):
        if self.n and self.w and abs(p - self.wx / self.w) <= self.tol:
            self.wx, self.w, self.n, self.labels = self.wx + p * w, self.w + w, self.n + m, self.labels.union(labels)
            return None
        closed = self.close()
        self.wx, self.w, self.n, self.labels = p * w, float(w), m, set(labels)
        return closed

    def close(self):
        return (self.wx / self.w if self.w else None, self.w, self.n, "+".join(sorted(self.labels))) if self.n else None

    @classmethod
    def whole(cls, first: np.ndarray, size: np.ndarray, values: list[pa.Array], facts: list[pa.Array]):
        """As ``add`` for every row and ``close``, for many keys: the r-th rows of all keys are one step."""
        p, w, m = (x.to_numpy(zero_copy_only=False) for x in values[:3])
        by = np.argsort(-size, kind="stable")
        at, n, tol = first[by], size[by], facts[0].to_numpy(zero_copy_only=False)[by]
        x, new = p * w, np.zeros(len(p), bool)
        new[first] = True
        wx, ws = x[at], w[at]
        for r in range(1, min(int(n[0]), cls.STEPS)):
            k = int(np.searchsorted(-n, -r))  # keys with more than r rows
            i = at[:k] + r
            with np.errstate(all="ignore"):
                joins = (ws[:k] != 0) & (np.abs(p[i] - wx[:k] / ws[:k]) <= tol[:k])
            new[i] = ~joins
            wx[:k], ws[:k] = (np.where(joins, s[:k] + y[i], y[i]) for s, y in ((wx, x), (ws, w)))
        for k in range(int(np.searchsorted(-n, -cls.STEPS))):  # few are so long
            sx, s, t, a = float(wx[k]), float(ws[k]), float(tol[k]), int(at[k])
            far = []
            for q, y, v in zip(*(c[a + cls.STEPS : a + n[k]].tolist() for c in (p, x, w))):
                joined = s != 0 and abs(q - sx / s) <= t
                far.append(not joined)
                sx, s = (sx + y, s + v) if joined else (y, v)
            new[a + cls.STEPS : a + n[k]] = far
        group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        of = np.repeat(np.arange(len(first)), size)[begins]
        strength = np.bincount(group, w)
        with np.errstate(all="ignore"):
            center = pa.array(np.bincount(group, x) / strength, mask=strength == 0)
        # labels: codes in the order of names, each once a group
        lists = values[3]
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        rank = np.argsort(sorted(range(len(names)), key=names.__getitem__))
        kinds = max(1, len(names))
        holder = np.repeat(group, lists.value_lengths().fill_null(0).to_numpy())
        pairs = np.unique(holder * kinds + rank[coded.indices.to_numpy()]) if len(names) else np.zeros(0, np.int64)
        ends = np.searchsorted(pairs // kinds, np.arange(len(begins) + 1))
        sources = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sorted(names), pa.string()).take(pa.array(pairs % kinds)))
        return of, np.arange(len(begins)) - group[first][of], [center, pa.array(strength), pa.array(np.add.reduceat(m, begins)), pc.binary_join(sources, "+")]

    def __getstate__(self):
        return self.__dict__ | ({"labels": tuple(sorted(self.labels))} if self.n else {})

    def __setstate__(self, state):
        self.__dict__ = state | ({"labels": set(state["labels"])} if state["n"] else {})


class MedianGroups:
    """The open group around the median of its members.

    Positions ascend, so the median only moves up: of each group the positions from the median on are
    kept, with their multiplicities.
    """

    def __init__(self, tol: float):
        self.facts, self.tol, self.n = (tol,), tol, 0

    def _median(self) -> float:
        """Mean of the middle members; positions below the lower one are let go."""
        low, high = (self.n - 1) // 2, self.n // 2
        while self.passed + self.kept[0][1] <= low:
            self.passed += self.kept.popleft()[1]
        upper = self.kept[0] if self.passed + self.kept[0][1] > high else self.kept[1]
        return (self.kept[0][0] + upper[0]) / 2

    def add(self, p: float, a: float, m: int):
        # equal positions enter one by one in the scan; the first decides for all, since joining only
        # moves the median towards them
        if self.n and abs(p - self._median()) <= self.tol:
            self.kept.append((p, m))
            self.n, self.area = self.n + m, self.area + a
            return None
        closed = self.close()
        self.kept, self.passed, self.n, self.area = deque([(p, m)]), 0, m, float(a)
        return closed

    def close(self):
        return (self._median(), self.n, self.area * (1 + 0.1 * (self.n - 1))) if self.n else None


def running_center_groups(
    df: DataFrame, key, pos: str, weight: Column, tol: Column, label: str | None = None, stats: list[Column] | None = None
) -> DataFrame:
    """Sorted positions join a group while they lie within ``tol`` of its running weighted mean.

    ``tol`` may use ``span`` (largest minus smallest position of the key) and any of ``stats``, which
    are aggregates of the rows of a key.
    The scan is order-dependent. It runs over the distinct positions of an image in order, and an image
    of any size is cut over several tasks that hand the open group on (:mod:`gaugeframe.operators.fold`).
    Rows without a position are left out, and a missing weight is 0.
    """
    keys = [key] if isinstance(key, str) else key
    labels = F.collect_set(label) if label else F.array().cast("array<string>")
    p = F.col(pos).cast("double")
    df = df.where(p.isNotNull())
    d = df.groupBy(*keys, p.alias("p")).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("w"), F.count(F.lit(1)).alias("m"), labels.alias("labels"))
    whole = df.groupBy(*keys).agg((F.max(p) - F.min(p)).alias("span"), *stats) if stats else d.groupBy(*keys).agg((F.max("p") - F.min("p")).alias("span"))
    facts = whole.select(*keys, tol.cast("double").alias("tol"))
    out = fold_groups(d, facts, keys, ["p"], CenterGroups, "center double, strength double, n_members long, sources string")
    return out if label else out.drop("sources")


def running_median_groups(df: DataFrame, key: str, pos: str, area: str, tol: Column) -> DataFrame:
    """Best base line: positions within ``tol`` of a group's median join it; the group with the
    largest ``area * (1 + 0.1 * (members - 1))`` gives its median. ``tol`` may use ``top``, the largest position."""
    p = F.col(pos).cast("double")
    df = df.where(p.isNotNull())
    d = df.groupBy(key, p.alias("p")).agg(F.coalesce(F.sum(area), F.lit(0)).cast("double").alias("a"), F.count(F.lit(1)).alias("m"))
    facts = d.groupBy(key).agg(F.max("p").alias("top")).select(key, tol.cast("double").alias("tol"))
    c = fold_groups(d, facts, [key], ["p"], MedianGroups, "median double, n long, score double", number="i")
    best = c.groupBy(key).agg(F.max(F.struct("score", (-F.col("i")).alias("e"), "median", "n")).alias("b"), F.count(F.lit(1)).alias("n_clusters"))
    return best.select(key, F.rint("b.median").cast("bigint").alias("baseline"), F.col("b.n").alias("n_bars"), rint_round(F.col("b.score")).alias("score"), "n_clusters")


# ------------------------------------------------------------------------------------ line phrases
def line_phrases(words: DataFrame, line: list[str]) -> DataFrame:
    """Words of a text line split into phrases at wide gaps.

    ``words``: line keys, ``x1, x2, y1, y2, h, conf, text``, ordered by ``x1, x2, text``.  The break
    width follows the small gaps and the word height of the line.  Words that start at the same pixel
    never part, so gaps are found between start pixels (at most one row each) and the phrase number
    is joined back to the words.
    """
    starts = words.groupBy(*line, "x1").agg(F.max("x2").alias("last"))
    w = _ordered(line, "x1")
    starts = starts.withColumn("gap", F.greatest(F.lit(0.0), F.col("x1") - F.lag("last").over(w)))
    gaps = F.array_sort(F.collect_list(F.when(F.col("gap") > 0.5, F.col("gap"))))  # at most one each start pixel
    small = starts.groupBy(*line).agg(gaps.alias("gaps")).select(*line, sorted_quantile(F.col("gaps"), 0.35).alias("small"))
    typical = words.groupBy(*line).agg(percentile(F.col("h"), 0.5).alias("typical"))
    wide = F.greatest(2.5 * F.col("small"), 1.45 * F.col("typical"))
    limit = F.when(F.col("small").isNotNull(), F.greatest(F.lit(10.0), F.least(F.lit(34.0), wide))).otherwise(
        F.greatest(F.lit(11.0), 1.45 * F.col("typical"))
    )
    limits = small.join(typical, line).select(*line, limit.alias("limit"))
    starts = starts.join(limits, line).withColumn("phrase", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(w))
    d = words.join(starts.select(*line, "x1", "phrase"), [*line, "x1"])
    width = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    items = F.array_sort(F.collect_list(F.struct("x1", "x2", "text")))
    return d.groupBy(*line, "phrase").agg(
        F.array_join(F.transform(items, lambda s: s["text"]), " ").alias("text"),
        F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"),
        rint_round(F.sum(F.col("conf") * width) / F.sum(width)).alias("confidence"),
    )


def near_best(df: DataFrame, key: str, score: str, share: float, order: list[Column]) -> DataFrame:
    """Among candidates close to the best score, the first in ``order`` (two map-combined passes)."""
    top = df.groupBy(key).agg(F.max(score).alias("__best"))
    near = df.join(top, key).where(F.col(score) >= share * F.col("__best"))
    return near.groupBy(key).agg(F.min(F.struct(*order, F.struct(*[F.col(c) for c in df.columns if c != key]).alias("row"))).alias("b")).select(key, "b.row.*")
