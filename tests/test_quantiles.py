"""Order statistics against the definition, with groups cut over several parts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators.quantiles import exact_quantiles


def by_definition(values, q):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    place = q * (len(v) - 1)
    low, high = v[math.floor(place)], v[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("parts", [1, 9])
def test_quantiles_of_hot_and_small_groups(spark, parts):
    r = random.Random(5)
    rows = [("hot", r.randrange(4000) / 7, float(r.randrange(3))) for _ in range(3000)]
    rows += [(f"k{i % 11}", r.choice([None, r.random()]), r.gauss(0, 9)) for i in range(90)]
    rows += [(None, 4.0, None), (None, 8.0, None), ("one", 2.5, -1.0), ("empty", None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a double, b double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {x.k: x for x in exact_quantiles(df, ["k"], {"qa": (F.col("a"), [0.0, 0.25, 0.5, 0.9, 1.0]), "qb": (F.col("b"), [0.5])}).collect()}
        nothing = exact_quantiles(df.where("false"), ["k"], {"qa": (F.col("a"), [0.5])}).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert nothing == 0 and set(got) == {k for k, *_ in rows} - {"empty"}
    for k, row in got.items():
        for column, place, qs in (("qa", 1, [0.0, 0.25, 0.5, 0.9, 1.0]), ("qb", 2, [0.5])):
            want = [by_definition([x[place] for x in rows if x[0] == k], q) for q in qs]
            if want[0] is None:
                assert row[column] is None
            else:
                assert row[column] == pytest.approx(want, abs=1e-9), (k, column)
