"""Cases of the review: small tables on which a query once differed from its SQL, and bounds on work."""

import math
import os
import random
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check import compare  # noqa: E402

from gaugeframe.functions import text as T  # noqa: E402
from gaugeframe.functions.numbers import fused, sorted_quantile  # noqa: E402
from gaugeframe.operators import consensus as K  # noqa: E402

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def line(order, part, supplier=1, number=1, quantity=1.0, price=1.0, discount=0.05, tax=0.01):
    return (order, part, supplier, number, float(quantity), float(price), discount, tax, "R", "F")


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    msg, _, _ = compare(E.queries()[name](spark, str(folder)), E.oracle_sql()[name], con)
    assert msg.startswith("ok"), msg


def test_gap_equal_to_the_phrase_limit(spark, tmp_path):
    """Gaps 9, 11 and 26: their quantile is 10.4 in the twin, and 2.5 times that is no wider than 26."""
    rows = [line(1, x) for x in (0, 10, 22, 49)] + [line(2, x) for x in (0, 10, 22, 50)] + [line(3, 5)]
    against_sql(spark, tmp_path, "e22_line_phrases", lineitem=spark.createDataFrame(rows, LINE))


def test_sorted_quantile_and_fused(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-300, 300), rng.random(), rng.uniform(-300, 300)) for _ in range(5000)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", fused(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()
    assert all(r.f == math.fma(r.a, r.b, r.c) for r in got)
    lists = [(i, sorted(float(rng.randrange(300)) for _ in range(rng.randrange(1, 17)))) for i in range(3000)] + [(3000, [])]
    con = duckdb.connect()
    con.execute("create table t (i int, v double)")
    con.executemany("insert into t values (?, ?)", [(i, x) for i, v in lists[:600] for x in v])
    for q in (0.1, 0.35, 0.75):
        want = dict(con.execute(f"select i, quantile_cont(v, {q}) from t group by i").fetchall())
        got = dict(spark.createDataFrame(lists, "i int, v array<double>").select("i", sorted_quantile(F.col("v"), q)).collect())
        assert all(got[i] == w for i, w in want.items()) and got[3000] is None


def random_axes(n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        pos = np.sort(rng.choice(400, int(rng.integers(1, 9)), replace=False)).astype(float)
        readings = []
        for p, x in enumerate(pos):
            found = dict.fromkeys([*([2.0 * x] if rng.random() < 0.7 else []), *(float(v) for v in rng.integers(0, 60, int(rng.integers(0, 4))) * 5)])
            firsts = rng.permutation(len(found))
            readings += [(p, v, float(rng.integers(0, 4)), float(rng.integers(-5, 120)), r, int(firsts[r])) for r, v in enumerate(found)]
        yield pos, readings


def test_axes_fitted_together_equal_axes_fitted_one_by_one(spark, monkeypatch):
    """One call fits the axes of a batch; axes with too many models are fitted by themselves in between."""
    axes = list(random_axes(400, 4))
    for each in (None, 2):
        want = [K.fit_axis(pos, *zip(*r), each) if r else None for pos, r in axes]
        some = [(a, w) for a, w in zip(axes, want) if w]
        columns = [np.array([x[i] for (_, r), _ in some for x in r]) for i in range(6)]
        got = K.fit_axes([len(p) for (p, _), _ in some], np.concatenate([p for (p, _), _ in some]), [len(r) for (_, r), _ in some], *columns, each)
        assert [K.AXIS_STATUSES[i] for i in got["status"]] == [w["status"] for _, w in some]
        assert got["n_inliers"].tolist() == [w["n_inliers"] for _, w in some] and got["n_selected"].tolist() == [w["n_selected"] for _, w in some]
        assert [None if math.isnan(v) else v for v in got["values"]] == [v for _, w in some for v in w["values"]]
        assert [K.AXIS_SOURCES[i] for i in got["sources"]] == [v for _, w in some for v in w["sources"]]
        assert [None if math.isnan(v) else v for v in got["slope"]] == [w["slope"] for _, w in some]
    assert len({w["status"] for w in want if w}) == 5

    rows = [(k, float(p), *(x if x is None or i == 3 else float(x) for i, x in enumerate((v, s, c, r)))) for k, (pos, readings) in enumerate(axes) for at, p in enumerate(pos) for v, s, c, r in [x[1:5] for x in readings if x[0] == at] or [(None, None, None, None)]]
    frame = spark.createDataFrame(rows, "k int, position double, value double, score double, confidence double, rank int")
    want = K.select_axis_values(frame, "k").collect()
    monkeypatch.setattr(K, "AXIS_CELLS", 150)
    got = K.select_axis_values(frame, "k").collect()
    assert len(want) == len(axes) and sorted(map(str, got)) == sorted(map(str, want))


def test_years_are_sought_in_words_with_digits_only(spark):
    """The same years as in the whole text normalised, and few ranges tried on every character."""
    rng = random.Random(6)
    odd = list("éÇß ﬁ½²③⒈２０１９̀ \t\n—$") + ["1999", "2024", "21", "19", "x", " ", "́"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 12))) for _ in range(4000)] + ["", "x" * 100_000 + " 1999 " + "é" * 100_000 + "2001"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    whole = F.regexp_extract_all(T.upper_basic(F.col("t")), F.lit(T.YEAR), F.lit(1))
    got = frame.select("t", T.years(F.col("t")).alias("y"), whole.alias("w")).collect()
    assert all(r.y == r.w for r in got) and sum(bool(r.y) for r in got) > 100 and got[-1].y is None
    several = T._accent_tables()[3]
    known = {p[0] for p in T._accent_tables()[2].split("\x01")}
    chars = [chr(c) for c in range(1, 0x3400)] + sorted(known)
    hit = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(several)).collect()
    assert {r.c for r in hit} == known and several.count("-") < 150


def test_distances_are_measured_once(spark):
    """One evaluation of the distances stands below each matching in the plan."""
    plan = E.queries()["g04_min_cost_color_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [delta_e_packed") == plan.count("ArrowEvalPython [_matching") > 0


def test_number_lists_as_text(spark):
    """As item by item, with each distinct number of a batch spelled once."""
    rng = random.Random(7)
    pool = [0.0, -0.0, 1.0, 2.5, 1e22, 1234567.5, 0.1 + 0.2, -3.0, 1e-12, 7.0 + 1e-10, float("inf")]
    lists = [(i, [(rng.choice(["PCT", "NUM", None]), rng.choice(pool)) for _ in range(rng.randrange(5))]) for i in range(400)] + [(400, None), (401, [("NUM", None), ("PCT", 2.0)])]
    got = dict(spark.createDataFrame(lists, "i int, v array<struct<typ: string, value: double>>").select("i", T.typed_numbers(F.col("v"))).collect())

    def shown(t, v):
        return str(round(v)) if t != "PCT" and math.isfinite(v) and abs(v - round(v)) < 1e-9 else f"{v:g}" + "%" * (t == "PCT")

    assert got.pop(400) is None and got.pop(401) == "2%"
    assert got == {i: " | ".join(shown(*x) for x in v) for i, v in lists[:400]}
