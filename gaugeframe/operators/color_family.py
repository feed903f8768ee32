"""Colour families of markers and lines: medoid, class, point distances, overlap colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.color import delta_e, hex_channels, lab_of, packed, with_lab
from gaugeframe.functions.numbers import rint_round
from gaugeframe.operators.color_match import hex_delta
from gaugeframe.operators.scan import changes

# --- fixed values -------------------------------------------------------------------------------
SOLID_RADIUS, SOLID_SUPPORT, SCALE_RANGE, DOMINANCE = 4.0, 0.85, 7.0, 1.5
BASE_SUPPORT, BASE_SEPARATION, BASE_PIXELS = 0.70, 45.0, 0.35
MIX_RESIDUAL, NEAR_BOTH, BIN_SHARE, BASE_GAP_PX = 12.0, 0.20, 0.25, 14
# ------------------------------------------------------------------------------------------------
TILE = 512
#: most colours whose distances a task keeps (32 MB)
TABLE = 2048


# ---------------------------------------------------------------------------------------- medoid
def marker_colors(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct colours of every family with the number of their markers and the first of them."""
    return markers.groupBy(*keys, "observed_hex").agg(F.count(F.lit(1)).alias("n"), F.min("marker_id").alias("first"))


class Distances:
    """Distances of colours in a task. ``of`` gives none while measuring each pair as it comes costs less.

    Pairs of all colours seen are measured into one table, of up to ``side`` colours, once the pairs asked for
    are as many; later ones are looked up. So no more than twice the pairs asked for are ever measured.
    """

    def __init__(self, side: int):
        self.side, self.asked, self.colors, self.table = side, 0, np.zeros(0, np.int64), np.zeros((0, 0))

    def of(self, colors: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The table, and the places in it of ``colors``, which are distinct and ascend."""
        self.asked += pairs
        every = np.union1d(self.colors, colors)
        if len(every) > self.side:
            return None
        if len(every) > len(self.colors):
            new = ~np.isin(every, self.colors)
            cost = len(every) * (len(every) - 1) // 2 - len(self.colors) * (len(self.colors) - 1) // 2
            if cost > self.asked:
                return None
            self.asked -= cost
            table, old = np.zeros((len(every),) * 2), np.flatnonzero(~new)
            table[np.ix_(old, old)] = self.table
            x, y = np.triu_indices(len(every), 1)
            x, y = (i[new[x] | new[y]] for i in (x, y))
            lab = lab_of(every)
            table[x, y] = table[y, x] = delta_e(tuple(v[x] for v in lab), tuple(v[y] for v in lab))
            self.colors, self.table = every, table
        return self.table, np.searchsorted(self.colors, colors)


def _pairs(column: dict[str, np.ndarray], starts: np.ndarray) -> int:
    """About the number of pairs that the tiles hold."""
    sizes = np.diff(np.append(starts, len(column["c"]))).astype(np.int64)
    return int((sizes * (sizes - 1) // 2).sum())


def _tile_sums(keys: list[str], names: list[str], most: int = 1 << 18):
    """Rows, sorted by family and tile, with their part of the summed distance in place of the colour.

    A tile holds one block of colours or two. Each pair of colours is measured once and adds to the sums of
    both; pairs of many small tiles are measured together, at most about ``most`` at a time. Colours
    that families share are measured once a task where that is less, see ``Distances``. Of a family of one block,
    whose sums are whole, only colours with the least mean go on, and those that rounding may make equal to it.
    """
    within: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    known = Distances(TABLE)

    def sums_of(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        column = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("c", "n", "n_points", "blocks", "block", "lo", "hi")}
        n, total = column["n"].astype(float), np.zeros(rows.num_rows)
        colors, own = np.unique(column["c"].astype(np.int64), return_inverse=True)
        lab, found = lab_of(colors), known.of(colors, _pairs(column, starts))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def measure() -> None:
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            p, q = own[a], own[b]
            d = delta_e(tuple(x[p] for x in lab), tuple(x[q] for x in lab)) if found is None else found[0][found[1][p], found[1][q]]
            total[:] += np.bincount(a, d * n[b], len(total)) + np.bincount(b, d * n[a], len(total))
            held.clear()

        waiting = 0
        for first, end in zip(starts, [*starts[1:], rows.num_rows]):
            if column["lo"][first] == column["hi"][first]:
                m = end - first
                if m not in within:
                    within[m] = np.triu_indices(m, 1)
                a, b = within[m]
            else:  # every colour of one block with every one of the other
                left = int(np.count_nonzero(column["block"][first:end] == column["lo"][first]))
                a, b = (x.ravel() for x in np.meshgrid(np.arange(left), np.arange(left, end - first), indexing="ij"))
            held.append((a + first, b + first))
            waiting += len(a)
            if waiting >= most:
                measure()
                waiting = 0
        if held:
            measure()
        mean = total / column["n_points"]
        least = np.repeat(np.minimum.reduceat(mean, starts), np.diff(np.append(starts, rows.num_rows)))
        keep = pa.array((column["blocks"] > 1) | (mean <= least + 2e-9))
        return pa.RecordBatch.from_arrays([*(rows.column(c).filter(keep) for c in names), pa.array(total).filter(keep)], [*names, "s"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = b if held is None else pa.concat_batches([held, b])
            begins = changes([held.column(c) for c in (*keys, "lo", "hi")])
            begins[0] = True
            starts = np.flatnonzero(begins)
            if len(starts) > 1:
                cut = int(starts[-1])
                yield sums_of(held.slice(0, cut), starts[:-1])
                held = held.slice(cut)
        if held is not None:
            yield sums_of(held, np.zeros(1, int))

    return run


def family_medoid(markers: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Marker colour with the least mean distance to all markers of its family.

    Markers are first counted per distinct colour. The distinct colours of a family (2^24 at most) are cut
    into blocks of about ``tile``, and every two blocks meet once, under a key of their own: a family of any
    size is spread over many tasks, a block is sent once for each partner, and no pair becomes a row.

    ``markers``: keys, marker_id, observed_hex. Markers without a colour of six hex digits are left out.
    """
    d = marker_colors(markers, keys).withColumn("c", packed(F.col("observed_hex"))).where("c is not null")
    family = Window.partitionBy(*keys)
    d = d.withColumns({"blocks": F.ceil(F.count(F.lit(1)).over(family) / tile), "n_points": F.sum("n").over(family)})
    d = d.withColumn("block", F.pmod(F.xxhash64("observed_hex"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.struct(F.least(q, "block").alias("lo"), F.greatest(q, "block").alias("hi")))
    dealt = d.withColumn("meet", F.explode(meets)).select(*keys, "n_points", "first", "observed_hex", "n", "c", "blocks", "block", "meet.lo", "meet.hi")
    tiles = dealt.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "block")
    names = [*keys, "n_points", "first", "observed_hex"]
    schema = T.StructType([*(dealt.schema[c] for c in names), T.StructField("s", T.DoubleType())])
    sums = tiles.mapInArrow(_tile_sums(keys, names), schema).groupBy(*names).agg(F.sum("s").alias("s"))
    mean = rint_round(F.col("s") / F.col("n_points"), 9)
    return sums.groupBy(*keys, "n_points").agg(F.min(F.struct(mean.alias("mean"), "first", F.col("observed_hex").alias("hex"))).alias("b")).select(
        *keys, "n_points", F.col("b.hex").alias("medoid_hex"), F.col("b.first").alias("medoid_id"), rint_round(F.col("b.mean")).alias("mean_delta_e")
    )


def family_class(markers: DataFrame, medoids: DataFrame, keys: list[str]) -> DataFrame:
    """Solid colour, brightness scale, saturation scale or mixed, from the spread around the medoid.

    Works on distinct colours with their counts; quantiles take the counts as frequencies.
    """
    d = hex_delta(marker_colors(markers, keys).join(medoids.select(*keys, "medoid_hex"), keys), "observed_hex", "medoid_hex", "d")
    d = with_lab(d, hex_channels(F.col("observed_hex")), "c").withColumn("c_chroma", F.hypot("c_a", "c_b"))
    total = F.sum("n")

    def quantile(c: str, q: float) -> Column:
        return F.percentile(F.col(c), F.lit(q), F.col("n"))

    def spread(c: str) -> Column:
        return F.when(total <= 3, F.max(c) - F.min(c)).otherwise(quantile(c, 0.9) - quantile(c, 0.1))

    g = d.groupBy(*keys, "medoid_hex").agg(
        total.alias("n_points"),
        rint_round(F.sum(F.when(F.col("d") <= SOLID_RADIUS, F.col("n")).otherwise(0)) / total).alias("solid_support"),
        rint_round(spread("c_l")).alias("l_range"),
        rint_round(spread("c_chroma")).alias("c_range"),
        rint_round(quantile("d", 0.5)).alias("de_median"),
        rint_round(F.max("d")).alias("de_max"),
    )
    l, c, tiny = F.col("l_range"), F.col("c_range"), F.lit(1e-6)
    label = (
        F.when(F.col("n_points") == 1, "INSUFFICIENT_POINTS")
        .when(F.col("solid_support") >= SOLID_SUPPORT, "SOLID_CANDIDATE")
        .when((l >= SCALE_RANGE) & (l >= DOMINANCE * F.greatest(c, tiny)), "BRIGHTNESS_SCALE_CANDIDATE")
        .when((c >= SCALE_RANGE) & (c >= DOMINANCE * F.greatest(l, tiny)), "SATURATION_SCALE_CANDIDATE")
        .otherwise("MIXED_SCALE_CANDIDATE")
    )
    return g.withColumn("encoding", label)


def point_distance(markers: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of every distinct marker colour to the expected colour of its family, with its count."""
    d = markers.groupBy(*keys, "observed_hex").agg(F.count(F.lit(1)).alias("n"))
    return hex_delta(d.join(matched.select(*keys, "expected_hex"), keys), "observed_hex", "expected_hex", "delta_e")


def point_stats(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, 90% and largest point distance per family from counted distances."""
    d = distances.withColumn("e", rint_round(F.col("delta_e")))
    micro = F.sum(F.rint(F.col("e") * 1e6) * F.col("n"))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n_points"),
        (F.rint(micro / F.sum("n")) / 1e6).alias("point_mean"),
        rint_round(F.percentile(F.col("e"), F.lit(0.5), F.col("n"))).alias("point_median"),
        rint_round(F.percentile(F.col("e"), F.lit(0.9), F.col("n"))).alias("point_p90"),
        F.max("e").alias("point_max"),
    )


# ------------------------------------------------------------------------------- overlap colours
@F.pandas_udf(T.DoubleType())
def _mixture(tr: pd.Series, tg: pd.Series, tb: pd.Series, ar: pd.Series, ag: pd.Series, ab: pd.Series, br: pd.Series, bg: pd.Series, bb: pd.Series) -> pd.Series:
    t, a, b = (np.column_stack([np.asarray(x, float) for x in c]) - 255.0 for c in ((tr, tg, tb), (ar, ag, ab), (br, bg, bb)))
    i = np.arange(101)[None, :]
    rest = t[:, None, :] - (i / 100.0)[:, :, None] * a[:, None, :]
    bb_ = np.einsum("nk,nk->n", b, b)
    vertex = 100.0 * np.einsum("nik,nk->ni", rest, b) / np.where(bb_ == 0, 1.0, bb_)[:, None]
    best = np.full(len(t), np.inf)
    for j in (np.floor(vertex), np.ceil(vertex)):
        wb = np.clip(j, 0, 100 - i) / 100.0
        gap = rest - wb[:, :, None] * b[:, None, :]
        best = np.minimum(best, np.einsum("nik,nik->ni", gap, gap).min(axis=1))
    return pd.Series(np.sqrt(best))


def mixture_residual(t: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Least RGB distance of ``t`` to ``wa*A + wb*B + (1-wa-wb)*white`` on the 0.01 grid.

    For a fixed ``wa`` the squared distance is a parabola in ``wb``, so the best grid value is one of
    the two next to its vertex: 202 points decide what the full grid of 5151 would.
    """
    return _mixture(*t, *a, *b)


def overlap_derived(families: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Families explained as an overlap of two others in their image.

    ``families``: key, family, r, g, b, core_support, pixels; ``evidence``: key, target, base_a,
    base_b, near_both, xbin (one row per measured triple).  Three equi-joins on (image, family);
    the work follows the evidence rows.
    """
    cols = ["r", "g", "b", "core_support", "pixels"]

    def side(name: str, col: str) -> DataFrame:
        return families.select(key, F.col("family").alias(col), *[F.col(c).alias(f"{name}_{c}") for c in cols])

    strong = F.col("core_support") >= BASE_SUPPORT
    a = families.where(strong).select(key, F.col("family").alias("base_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = families.where(strong).select(key, F.col("family").alias("base_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    enough = families.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(key)
    e = evidence.where((F.col("near_both") >= NEAR_BOTH) | (F.col("xbin") >= BIN_SHARE)).join(enough, key, "left_semi")
    j = e.join(side("t", "target"), [key, "target"]).join(a, [key, "base_a"]).join(b, [key, "base_b"])
    rgb = {p: tuple(F.col(f"{p}_{c}").cast("double") for c in "rgb") for p in "tab"}
    gap = F.sqrt(sum((x - y) * (x - y) for x, y in zip(rgb["a"], rgb["b"])))
    j = j.where((gap >= BASE_SEPARATION) & (F.least("a_pixels", "b_pixels") >= F.col("t_pixels") * BASE_PIXELS))
    j = j.withColumn("residual", mixture_residual(rgb["t"], rgb["a"], rgb["b"])).where(F.col("residual") <= MIX_RESIDUAL)
    score = rint_round(1.0 - F.least(F.lit(1.0), F.col("residual") / MIX_RESIDUAL) + F.col("near_both") + F.col("xbin"), 9)
    row = F.struct(score.alias("score"), (-F.col("base_a")).alias("na"), (-F.col("base_b")).alias("nb"), F.col("residual"))
    best = j.groupBy(key, F.col("target").alias("family")).agg(F.max(row).alias("m"))
    out = families.select(key, "family").join(best, [key, "family"], "left")
    return out.select(
        key, "family",
        F.when(F.col("m").isNotNull(), "OVERLAP_DERIVED").otherwise("BASE").alias("role"),
        (-F.col("m.na")).alias("base_a"), (-F.col("m.nb")).alias("base_b"), rint_round(F.col("m.residual")).alias("residual"),
    )


def bin_cooccurrence(rows: DataFrame, triples: DataFrame, key: str) -> DataFrame:
    """Share of the target's bins where both bases run close together and the target lies near.

    ``rows``: key, family, bin, y (any number per bin); ``triples``: key, target, base_a, base_b.
    One median per (family, bin) comes first, so the joins see at most one row per family and bin.
    """
    med = rows.groupBy(key, "family", "bin").agg(F.percentile(F.col("y"), F.lit(0.5)).alias("my"))
    t = med.select(key, F.col("family").alias("target"), "bin", F.col("my").alias("yt"))
    a = med.select(key, F.col("family").alias("base_a"), "bin", F.col("my").alias("ya"))
    b = med.select(key, F.col("family").alias("base_b"), "bin", F.col("my").alias("yb"))
    j = triples.join(t, [key, "target"]).join(a, [key, "base_a", "bin"], "left").join(b, [key, "base_b", "bin"], "left")
    close = F.abs(F.col("ya") - F.col("yb")) <= BASE_GAP_PX
    near = F.col("yt").between(F.least("ya", "yb") - BASE_GAP_PX, F.greatest("ya", "yb") + BASE_GAP_PX)
    hit = F.coalesce((close & near & F.col("ya").isNotNull() & F.col("yb").isNotNull()).cast("int"), F.lit(0))
    return j.groupBy(key, "target", "base_a", "base_b").agg(F.count(F.lit(1)).alias("n_bins"), rint_round(F.avg(hit)).alias("share"))


# --------------------------------------------------------------------------- common observed rows
def observed_colors(bars: DataFrame, lines: DataFrame, scatter: DataFrame) -> DataFrame:
    """Bars, lines and scatter families in one shape: hex, representation, type, support, marks."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select("filename", "observed_hex", F.lit(name).alias("representation"), "family_type", "support", "n_marks")

    return rows(bars, "BAR").unionByName(rows(lines, "LINE")).unionByName(rows(scatter, "MARKER"))


def observed_counts(observed: DataFrame) -> DataFrame:
    return observed.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n_observed_colors"),
        F.sum("n_marks").alias("n_marks"),
        F.max((F.col("family_type") == "VARIATION").cast("int")).alias("internal_variation"),
        rint_round(F.avg("support")).alias("support_mean"),
        rint_round(F.min("support")).alias("support_min"),
    )
