"""Running values and spread joins, with keys that are cut over several parts."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators.scan import running, spread_join


@pytest.mark.parametrize("parts", [1, 7])
def test_running_values_cross_part_borders(spark, parts):
    r = random.Random(3)
    rows = [("hot", i, r.randrange(100), r.getrandbits(62)) for i in range(900)] + [(None if k % 5 == 0 else f"k{k:02d}", i * 40 + k, r.randrange(9), r.getrandbits(60)) for k in range(40) for i in range(r.randrange(4))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, n long, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, running(df, ["k"], ["at"], sums=["n"], xors=["x"]).collect()), key=lambda t: (t[0] or "", t[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = [], {}
    for k, at, n, x in sorted(rows, key=lambda t: (t[0] or "", t[1])):
        place, total, mixed = seen.get(k, (0, 0, 0))
        seen[k] = place + 1, total + n, mixed ^ x
        want.append((k, at, seen[k][1], seen[k][2], seen[k][0]))
    assert got == want
    assert running(df.where("false"), ["k"], ["at"], sums=["n"]).count() == 0


@pytest.mark.parametrize("share", [2, 1000])
def test_spread_join_equals_a_plain_join(spark, share):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [(f"k{i % 7}", i) for i in range(30)] + [(None, 1), ("alone", 2)], "k string, i int")
    right = left.where("k <> 'alone'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total"))
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), ["k"], how)
        got = spread_join(left, right, ["k"], "n", how, share)
        key = lambda t: (t[0] or "", t[1])
        assert sorted(map(tuple, got.select("k", "i", "total").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
