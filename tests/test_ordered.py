import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import ordered as O
from gaugeframe.operators.pairs import pair_gaps


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def per_key(rows):
    return {k: [r[1:] for r in g] for k, g in groupby(sorted(rows), key=lambda r: r[0])}


def test_hue_ring(spark, rng):
    rows = [(k, round(rng.uniform(0, 360), 2) % 360, float(rng.randrange(1, 9))) for k in range(80) for _ in range(rng.randrange(1, 9))]
    rows += [(900, 350.0, 1.0), (900, 5.0, 1.0), (901, 0.0, 1.0)] + [(902, float(h), 1.0) for h in range(0, 360, 20)]
    got = {}
    for r in O.hue_families(spark.createDataFrame(rows, "k int, hue double, w double"), "k", "hue", "w").collect():
        got.setdefault(r.k, []).append(r.n_markers)
    for k, ms in per_key(rows).items():
        hues = [h for h, _ in ms]
        seen, sizes = set(), []
        for i in range(len(hues)):
            if i in seen:
                continue
            stack, size = [i], 0
            while stack:
                j = stack.pop()
                if j in seen:
                    continue
                seen.add(j)
                size += 1
                stack += [m for m in range(len(hues)) if m not in seen and min(abs(hues[m] - hues[j]), 360 - abs(hues[m] - hues[j])) <= 25]
            sizes.append(size)
        assert sorted(got[k]) == sorted(sizes), k


def test_lane_groups_end_where_two_empty_bins_follow(spark, rng):
    rows = sorted({(k, rng.randrange(40)) for k in range(60) for _ in range(rng.randrange(1, 16))})
    rows += [(100, b) for b in (3, 4, 6, 8)] + [(101, b) for b in (3, 6, 7, 39)] + [(102, 0)]
    got = {r.k: r.n_groups for r in O.lane_groups(spark.createDataFrame(rows, "k int, b int"), "k", "b", 40, 20, 790).collect()}
    assert (got[100], got[101], got[102]) == (1, 3, 1)
    for k in got:
        bins = sorted(b for kk, b in rows if kk == k)
        assert got[k] == 1 + sum(b - a > 2 for a, b in zip(bins, bins[1:]))


def test_interval_union(spark, rng):
    rows = [(k, a, a + rng.randrange(0, 60)) for k in range(40) for a in (rng.randrange(900) for _ in range(rng.randrange(1, 9)))]
    got = {r.k: (r.covered, r.n_segments) for r in O.interval_union(spark.createDataFrame(rows, "k int, a int, b int"), "k", "a", "b", 1200.0).collect()}
    for k, iv in per_key(rows).items():
        # adjacent pixels join without changing the covered length
        assert got[k] == (len({x for a, b in iv for x in range(a, b + 1)}), len(iv))


def cut(items, sizes):
    """The sorted items of a key in runs of the given sizes."""
    ends = np.cumsum(sizes)
    assert ends[-1] == len(items)
    return [items[e - n : e] for e, n in zip(ends, sizes)]


def mean(run):
    return np.average([p for p, *_ in run], weights=[w for _, w in run])


@pytest.fixture(params=[1, 6])
def parts(request, spark):
    """Shuffles into so many parts, none merged."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def assert_near_the_mean_before(items, groups, tol):
    """Groups are runs of the sorted items; each item is near the mean of those before it, the next run's first is not."""
    runs = cut(sorted(items), [n for _, n in groups])
    assert [round(c, 6) for c, _ in groups] == [round(mean(r), 6) for r in runs]
    for run in runs:
        assert all(abs(run[i][0] - mean(run[:i])) <= tol + 1e-9 for i in range(1, len(run)) if run[i][0] != run[i - 1][0])
    assert all(abs(later[0][0] - mean(run)) > tol - 1e-9 for run, later in zip(runs, runs[1:]))


@pytest.mark.parametrize("weighted", [True, False])
def test_running_center(spark, rng, parts, weighted):
    rows = [(k, float(rng.randrange(0, 200)), float(rng.randrange(1, 5)) if weighted else 1.0) for k in range(60) for _ in range(rng.randrange(1, 12))]
    rows += [(7, None, 1.0)]
    # one key over several parts: with wide and with narrow gaps
    rows += [(100, float(x) / 3, 1.0) for x in range(0, 3000, 2)] + [(101, float(x * x % 50_000), float(1 + x % 3)) for x in range(1500)]
    df = spark.createDataFrame(rows, "k int, p double, w double")
    got = {}
    for r in O.running_center_groups(df, "k", "p", F.col("w"), F.greatest(F.lit(10.0), 0.0035 * F.col("span"))).orderBy("k", "group").collect():
        assert r.group == len(got.setdefault(r.k, []))
        got[r.k].append((r.center, r.n_members))
    for k, items in per_key([r for r in rows if r[1] is not None]).items():
        assert_near_the_mean_before(items, got[k], max(10.0, 0.0035 * (max(items)[0] - min(items)[0])))


def test_running_center_by_hand(spark):
    rows = [(1, 0.0, 1.0, "a"), (1, 4.0, 3.0, "b"), (1, 12.9, 1.0, "a"), (1, 14.0, 1.0, "c"), (2, 5.0, 2.0, None)]
    got = O.running_center_groups(spark.createDataFrame(rows, "k int, p double, w double, l string"), "k", "p", F.col("w"), F.lit(10.0), label="l").orderBy("k", "group")
    # 0 and 4 have the mean 3, 12.9 joins them (mean 4.98), 14 is 9.02 away from that
    assert [(r.k, r.group, round(r.center, 4), r.strength, r.n_members, r.sources) for r in got.collect()] == [(1, 0, 6.4833, 6.0, 4, "a+b+c"), (2, 0, 5.0, 2.0, 1, "")]
    far = O.running_center_groups(spark.createDataFrame(rows, "k int, p double, w double, l string"), "k", "p", F.col("w"), F.lit(9.0))
    assert [(r.k, round(r.center, 4)) for r in far.orderBy("k", "group").collect()] == [(1, 3.0), (1, 13.45), (2, 5.0)]


def test_baseline(spark, rng, parts):
    from gaugeframe.operators.fold import fold_groups

    rows = [(k, float(rng.randrange(580, 640)), float(rng.randrange(1, 50))) for k in range(60) for _ in range(rng.randrange(1, 10))]
    rows += [(100, float(x) / 2, 1.0) for x in range(1200)] + [(101, 600.0, 2.0)] * 50
    df = spark.createDataFrame(rows, "k int, p double, a double")
    got = {r.k: r for r in O.running_median_groups(df, "k", "p", "a", F.lit(8.0)).collect()}
    d = df.groupBy("k", "p").agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("m"))
    groups = {}
    for r in fold_groups(d, df.select("k", F.lit(8.0).alias("t")).distinct(), ["k"], ["p"], O.MedianGroups, "median double, n long, score double").orderBy("k", "group").collect():
        groups.setdefault(r.k, []).append(r)
    for k, items in per_key(rows).items():
        runs = cut(sorted(items), [g.n for g in groups[k]])
        for run, g in zip(runs, groups[k]):
            places = [p for p, _ in run]
            assert g.median == np.median(places) and abs(g.score - sum(a for _, a in run) * (1 + 0.1 * (len(run) - 1))) < 1e-6
            assert all(abs(places[i] - np.median(places[:i])) <= 8.0 for i in range(1, len(run)) if places[i] != places[i - 1])
        assert all(abs(later[0][0] - np.median([p for p, _ in run])) > 8.0 for run, later in zip(runs, runs[1:]))
        top = max(g.score for g in groups[k])
        first = next(g for g in groups[k] if g.score == top)
        assert (got[k].baseline, got[k].n_bars, got[k].n_clusters) == (round(first.median), first.n, len(groups[k]))


def test_gap_scales(spark, rng):
    rows = [(k, float(rng.choice([0, 1, 2, 3, 40, 41, 43, 90, 91]))) for k in range(50) for _ in range(rng.randrange(1, 8))]
    hand = {100: [10.0, 10.0, 12.0, 60.0], 101: [0.0, 30.0, 60.0], 102: [5.0, 5.0], 103: [1.0, 1.5, 2.0], 104: [0.0, 10.0, 32.0]}
    rows += [(k, p) for k, ps in hand.items() for p in ps]
    got = {}
    for r in O.gap_scale_groups(spark.createDataFrame(rows, "k int, p double"), "k", "p").orderBy("k", "center").collect():
        got.setdefault(r.k, []).extend([(r.center, r.n_members)])
    # two scales; one scale; two centres; only gaps of one or less; the smallest ratio of two scales
    assert got[100] == [(32 / 3, 3), (60.0, 1)] and got[101] == [(0.0, 1), (30.0, 1), (60.0, 1)] and got[102] == [(5.0, 1), (5.0, 1)]
    assert got[103] == [(1.5, 3)] and got[104] == [(5.0, 2), (32.0, 1)]
    for k, ps in per_key(rows).items():
        places = np.sort([p for (p,) in ps])
        runs, gaps = cut(places, [n for _, n in got[k]]), np.diff(places)
        wide = gaps[gaps > 1]
        assert [c for c, _ in got[k]] == pytest.approx([r.mean() for r in runs])
        if len(places) > 2 and len(wide) and wide.max() >= 2.2 * wide.min():
            limit = math.sqrt(wide.min() * wide.max())
            assert all((np.diff(r) <= limit).all() for r in runs) and all(b[0] - a[-1] > limit for a, b in zip(runs, runs[1:]))
        else:
            assert len(runs) == (1 if len(places) > 2 and not len(wide) else len(places))


def test_pair_gaps(spark, rng):
    rows = [(k, float(rng.randrange(30))) for k in range(40) for _ in range(rng.randrange(1, 8))]
    got = {r.k: r for r in pair_gaps(spark.createDataFrame(rows, "k int, p double"), "k", "p").collect()}
    for k, ps in per_key(rows).items():
        v = [p for (p,) in ps]
        gaps = [abs(a - b) for i, a in enumerate(v) for b in v[i + 1 :]]
        assert got[k].n_pairs == len(gaps)
        if gaps:
            assert (got[k].min_gap, got[k].max_gap) == (min(gaps), max(gaps)) and abs(got[k].mean_gap - sum(gaps) / len(gaps)) < 1e-5


def test_many_keys_fold_as_one_by_one(rng, monkeypatch):
    """Keys that lie whole in a batch are folded together, with the groups that row after row gives."""
    import pyarrow as pa

    monkeypatch.setattr(O.CenterGroups, "STEPS", 6)
    size = np.array([rng.randrange(1, 12) for _ in range(300)])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    tol = [float(rng.choice([0, 3, 10])) for _ in size]
    rows = []
    for n in size:
        for p in sorted(rng.sample(range(60), n)):
            rows.append((float(p), float(rng.choice([0, 0, 1, 2.5])), rng.randrange(1, 4), rng.sample(["b", "a", "ç", "B"], rng.randrange(0, 3))))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string())))]
    of, seq, groups = O.CenterGroups.whole(first, size, columns, [pa.array(tol)])
    got = list(zip(of.tolist(), seq.tolist(), *(c.to_pylist() for c in groups)))
    want = []
    for k, (a, n) in enumerate(zip(first, size)):
        fold = O.CenterGroups(tol[k])
        closed = [g for g in [*(fold.add(*r) for r in rows[a : a + n]), fold.close()] if g]
        want += [(k, i, *g) for i, g in enumerate(closed)]
    assert got == want
