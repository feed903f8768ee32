import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gaugeframe.functions.color import PALETTE, delta_e, lab_of
from gaugeframe.operators import color_family as CF
from gaugeframe.operators import color_match as CM
from gaugeframe.operators.color_rollup import raw_unit_rollup

# published CIEDE2000 test pairs (Sharma, Wu, Dalal 2005)
PAIRS = [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.8361, -74.0200), (50, 0, -82.7485), 3.4412),
    ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0000), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, -1, 2), (50, 0, 0), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, -0.001, 2.49), (50, 0.0009, -2.49), 4.8045), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((50, 2.5, 0), (73, 25, -18), 27.1492),
    ((50, 2.5, 0), (61, -5, 29), 22.8977), ((50, 2.5, 0), (56, -27, -3), 31.9030), ((50, 2.5, 0), (58, 24, 15), 19.4535), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.6940), (23.0331, 14.9730, -42.5619), 2.0373), ((90.8027, -2.0831, 1.4410), (91.1528, -1.6435, 0.0447), 1.4441), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
]


def num(h):
    return int(h[1:], 16)


def de(a, b):
    return float(delta_e(lab_of(np.array([num(a)])), lab_of(np.array([num(b)])))[0])


def test_published_pairs():
    for p, q, want in PAIRS:
        got = delta_e(tuple(np.array([x], float) for x in p), tuple(np.array([x], float) for x in q))[0]
        assert abs(got - want) < 1e-4, (p, q, got)


def test_assignment_is_the_cheapest(spark):
    rng = random.Random(3)
    hexes = [f"#{rng.randrange(1 << 24):06X}" for _ in range(9)] + ["#1F4FD8"] * 2
    obs, imgs = [], []
    for k in range(60):
        prof = ("ONE", "TWO", "FIVE")[k % 3]
        imgs.append((k, prof))
        obs += [(k, prof, i, rng.choice(hexes)) for i in range(rng.randrange(0, 6))]
    exp = [("ONE", 1, "#C62828"), ("TWO", 1, "#EF6C00"), ("TWO", 2, "#1F4FD8")]
    exp += [("FIVE", i + 1, h) for i, h in enumerate(["#C62828", "#EF6C00", "#1F4FD8", "#2E7D32", "#6A1B9A"])]
    pairs = CM.color_pairs(
        spark.createDataFrame(obs, "k int, profile string, observed_index int, observed_hex string"),
        spark.createDataFrame(exp, "profile string, expected_index int, expected_hex string"),
        spark.createDataFrame(imgs, "k int, profile string"), "k",
    ).collect()
    for k, prof in imgs:
        mine = [o for o in obs if o[0] == k]
        want = [e for e in exp if e[0] == prof]
        n = min(len(mine), len(want))
        best = min((sum(de(o[3], e[2]) for o, e in zip(os_, es)) for os_ in itertools.permutations(mine, n) for es in itertools.combinations(want, n)), default=0.0)
        got = [p for p in pairs if p.k == k]
        hit = [p for p in got if p.pair_status == "MATCHED"]
        assert len(hit) == n and abs(sum(p.delta_e for p in hit) - best) < 1e-9
        assert sum(p.pair_status == "EXTRA" for p in got) == len(mine) - n
        assert sum(p.pair_status == "MISSING" for p in got) == len(want) - n
        assert all(p.delta_e is None for p in got if p.pair_status != "MATCHED")


def test_medoid_is_the_same_over_tiles(spark):
    rng = random.Random(5)
    rows = [(1, 1, i, f"#{rng.randrange(1 << 24):06X}") for i in range(40)] + [(1, 2, 100 + i, "#102030") for i in range(3)]
    rows += [(1, 1, 50 + i, rows[i][3]) for i in range(10)]
    df = spark.createDataFrame(rows, "filename int, family int, marker_id int, observed_hex string")
    small = {r.family: r for r in CF.family_medoid(df, ["filename", "family"], tile=8).collect()}
    big = {r.family: r for r in CF.family_medoid(df, ["filename", "family"]).collect()}
    for f in (1, 2):
        mine = [r for r in rows if r[1] == f]
        means = {r[3]: sum(de(r[3], o[3]) for o in mine) / len(mine) for r in mine}
        best = min(mine, key=lambda r: (round(means[r[3]], 9), r[2]))
        assert small[f].medoid_hex == big[f].medoid_hex == best[3]
        assert abs(big[f].mean_delta_e - means[best[3]]) < 1e-6


def test_medoid_leaves_out_what_is_no_colour_and_takes_the_first_of_ties(spark):
    rows = [(1, 9, "#102030"), (1, 3, "#405060"), (1, 5, None), (1, 1, "red"), (2, 4, None), (3, 7, "#FFFFFF"), (3, 7, "#FFFFFF")]
    df = spark.createDataFrame(rows, "family int, marker_id int, observed_hex string")
    got = {r.family: (r.n_points, r.medoid_hex, r.medoid_id) for r in CF.family_medoid(df, ["family"], tile=1).collect()}
    assert got == {1: (2, "#405060", 3), 3: (2, "#FFFFFF", 7)}
    assert CF.family_medoid(df.where("false"), ["family"]).count() == 0


def test_colours_that_families_share_are_measured_once(monkeypatch):
    rng, measured = np.random.default_rng(2), []
    monkeypatch.setattr(CF, "delta_e", lambda p, q: measured.append(len(p[0])) or delta_e(p, q))
    colors, families = rng.choice(1 << 24, 60, replace=False), 200
    rows = [(k, int(c), int(rng.integers(1, 5))) for k in range(families) for c in rng.choice(colors, 30, replace=False)]
    def column(i):
        return pa.array([r[i] for r in rows], pa.int64())
    none, one, two = (pa.array([i] * len(rows), pa.int64()) for i in (0, 1, 2))
    found = {}
    for blocks in (one, two):
        batch = pa.RecordBatch.from_arrays([column(0), column(1), column(2), one, blocks, none, none, none], ["k", "c", "n", "n_points", "blocks", "block", "lo", "hi"])
        measured.clear()
        got = [r for b in CF._tile_sums(["k"], ["k", "c"])(batch.slice(i, 700) for i in range(0, len(rows), 700)) for r in b.to_pylist()]
        assert sum(measured) <= 2 * 60 * 59 // 2  # before: families * 30 * 29 / 2
        found[blocks[0].as_py()] = got
    assert len(found[1]) == families and len(found[2]) == len(rows)  # before: every colour of either
    for k in (0, 77, families - 1):
        mine = [r for r in rows if r[0] == k]
        lab = lab_of(np.array([r[1] for r in mine]))
        want = delta_e(tuple(x[:, None] for x in lab), tuple(x[None, :] for x in lab)) @ np.array([r[2] for r in mine])
        assert np.allclose([r["s"] for r in found[2] if r["k"] == k], want, rtol=1e-12)
        (best,) = (r for r in found[1] if r["k"] == k)
        assert best["c"] == mine[int(want.argmin())][1] and abs(best["s"] - want.min()) < 1e-9


def test_colours_are_measured_as_they_come_where_a_table_costs_more():
    known = CF.Distances(8)
    assert known.of(np.arange(4), 5) is None and known.of(np.arange(9), 1000) is None
    table, at = known.of(np.array([3, 7]), 1)
    assert table.shape == (2, 2) and list(at) == [0, 1]
    table, at = known.of(np.array([1, 7, 9]), 100)
    lab = lab_of(np.array([1, 3, 7, 9]))
    want = delta_e(tuple(x[:, None] for x in lab), tuple(x[None, :] for x in lab))
    assert list(at) == [0, 2, 3] and np.allclose(table, want, atol=1e-12)


def test_mixture_equals_full_grid(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(x) for x in rng.integers(0, 256, 9)) for _ in range(30)] + [(10.0, 20.0, 30.0) + (255.0,) * 6]
    names = ["tr", "tg", "tb", "ar", "ag", "ab", "br", "bg", "bb"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    t, a, b = (tuple(F.col(f"{p}{c}") for c in "rgb") for p in "tab")
    got = [r[-1] for r in df.select("*", CF.mixture_residual(t, a, b).alias("x")).collect()]
    w = [(i / 100, j / 100) for i in range(101) for j in range(101 - i)]
    for r, g in zip(rows, got):
        tt, aa, bb = (np.array(r[k : k + 3]) for k in (0, 3, 6))
        assert abs(g - min(np.linalg.norm(tt - (x * aa + y * bb + (1 - x - y) * 255)) for x, y in w)) < 1e-9


def test_distinct_colors_name_the_nearest_palette_colour(spark):
    rows = [(1, "#1F4FD8", 5, 0.5, 0.9), (1, "#1F4FD8", 7, 0.7, 0.7), (1, "#C62829", 40, 0.2, 0.3), (2, "none", 1, 0.1, 0.1), (2, None, 1, None, 0.1)]
    bars = spark.createDataFrame(rows, "filename long, hex string, pixels long, support_exact double, support_near double")
    got = {(r.filename, r.hex): r for r in CM.distinct_colors(bars, "filename", "hex", PALETTE).collect()}
    blue, red = got[1, "#1F4FD8"], got[1, "#C62829"]
    assert (blue.n_bars, blue.pixel_sum, blue.support_exact_mean, blue.support_exact_min, blue.support_near_mean, blue.support_near_min) == (2, 12, 0.6, 0.5, 0.8, 0.7)
    assert (blue.nearest_name, blue.nearest_hex, blue.delta_e, blue.color_rank) == ("azul", PALETTE["azul"], 0.0, 2)
    assert (red.nearest_name, red.color_rank) == ("vermelho", 1) and 0 < red.delta_e < 1
    assert all(got[2, h].nearest_name is None and got[2, h].delta_e is None for h in ("none", None))


def test_nearest_colour_ties_go_to_the_earlier_name(spark):
    one = spark.createDataFrame([("#102030",)], "hex string")
    assert CM.nearest_named(one, "hex", {"b": "#102030", "a": "#102030"}).first().nearest_name == "b"


def test_image_report_without_marks_and_points(spark):
    pairs = spark.createDataFrame(
        [(1, "MATCHED", 4, "#AA0000", 2, PALETTE["azul"], 1.5), (1, "MATCHED", 3, "#00AA00", 1, PALETTE["laranja"], 0.5), (1, "EXTRA", 1, "#0000AA", None, None, None), (2, "MISSING", None, None, 1, "#123456", None)],
        "filename long, pair_status string, observed_index long, observed_hex string, expected_index long, expected_hex string, delta_e double",
    )
    kinds = {c: "string" if c in ("extraction_status", "line_derived_hex") else "double" if "support" in c else "long" for c in CM.EXTRACTED}
    some = {"canvas_width": 640, "n_variable_families": 2, "extraction_status": "OK"}
    extraction = spark.createDataFrame([(1, *(some.get(c) for c in CM.EXTRACTED)), (2, *(None for _ in CM.EXTRACTED))], "filename long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    points = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None)], "filename long, delta_e double")
    a, b = CM.image_report(pairs, extraction, points, "filename", PALETTE).orderBy("filename").collect()
    assert (a.expected_colors, a.expected_hex) == ("laranja|azul", f"{PALETTE['laranja']}|{PALETTE['azul']}")
    assert (a.observed_hex, a.matched_hex) == ("#0000AA|#00AA00|#AA0000", "#00AA00|#AA0000")
    assert (a.point_mean, a.point_median, a.point_p90, a.point_max, a.internal_variation, a.count_status) == (2.0, 2.0, 2.8, 3.0, 1, "EXTRA")
    assert (b.count_status, b.expected_colors, b.observed_hex, b.point_max, b.n_variable_families, b.internal_variation, b.line_derived_hex) == ("NO_MARK", "#123456", "", None, 0, 0, "")


def test_raw_units_count_repeats_and_rates(spark):
    names = "unit_id long, dmax double, dmean double, n_expected long, n_matched long, n_observed long, n_extra long, n_missing long, extraction_status string, internal_variation int, n_overlap_derived long, support double, point_max double, point_p90 double"
    rows = [(1, 2.0, 1.0, 2, 2, 2, 0, 0, "OK", 0, 1, 0.5, 4.0, 3.0), (1, None, None, 2, 0, 0, 0, 2, "NO_MARK", None, None, None, None, None), (2, 1.0, 1.0, 1, 1, 3, 2, 0, "OK", 1, 0, 0.2, None, None)]
    a, b = raw_unit_rollup(spark.createDataFrame(rows, names), "unit_id", 2).orderBy("unit_id").collect()
    assert (a.n_repeats_found, a.expected_repeats, a.repeats_complete, a.n_color_evaluable, b.repeats_complete) == (2, 2, 1, 1, 0)
    assert (a.completeness, a.p_missing, a.p_exact_count, a.p_complete, a.p_no_mark, a.p_line_overlap_derived, a.p_internal_variation) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.0)
    assert (a.observed_colors_mean, a.missing_colors_mean, b.extra_colors_mean, b.p_extra, a.point_max_mean, b.point_p90_mean) == (1.0, 1.0, 2.0, 1.0, 4.0, None)
