import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import integrate as I
from gaugeframe.operators import rates as R
from gaugeframe.operators import sampling as P
from gaugeframe.operators import sets as SE
from gaugeframe.sources import jsonfiles as J
from gaugeframe.sources import tables as W
from gaugeframe.streaming import incremental as INC


def frame(spark, n):
    return spark.range(n).select((F.col("id") % 3).alias("profile"), F.col("id").alias("filename"))


def test_draws_do_not_depend_on_partitioning(spark):
    a = P.first_per_group(frame(spark, 500).repartition(7), ["profile"], [P.draw(1, "filename")], 5).collect()
    b = P.first_per_group(frame(spark, 500).repartition(2, "filename"), ["profile"], [P.draw(1, "filename")], 5).collect()
    assert sorted(a) == sorted(b) and len(a) == 15


def test_short_strata_fail_the_same_job(spark):
    """Ten rows: profile 0 has four, the others three."""
    rows = frame(spark, 10).withColumn("unit", F.col("filename"))
    design = spark.createDataFrame([(i,) for i in range(4)], "profile long")
    draws = [P.draw(1, "filename")]
    turns = rows.select("unit", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    short = {
        "profile=1 has 3 of 4": lambda: P.stratified(rows, ["profile"], draws, 4).where("profile = 1"),
        "profile=3 has 0 of 3": lambda: P.stratified(rows, ["profile"], draws, 3, design),
        "profile=[12] has 3 of 4": lambda: P.unit_sample(rows, rows, ["profile"], "unit", "filename", 4, 1),
        "has 10 of 11": lambda: P.whole_unit_sample(turns, "unit", "turn", 0, 2, 11, 1),
        "has 0 of 1": lambda: P.whole_unit_sample(turns, "unit", "turn", 0, 3, 1, 1),
        "has 3 of 5": lambda: P.blind_cases(rows.where("profile = 1"), "profile", "filename", 5, 1),
    }
    for said, sample in short.items():
        with pytest.raises(Exception, match=said):
            sample().collect()
    assert P.stratified(rows, ["profile"], draws, 3, design.where("profile < 3")).count() == 9
    assert P.unit_sample(rows, rows, ["profile"], "unit", "filename", 3, 1).count() == 9
    assert P.whole_unit_sample(turns, "unit", "turn", 0, 2, 10, 1).count() == 10


def test_rank_is_cut_before_the_shuffle(spark):
    plan = P.first_per_group(frame(spark, 500), ["profile"], [P.draw(1, "filename")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_whole_units_need_every_repeat_once(spark):
    rows = [(1, r) for r in range(1, 11)] + [(2, r) for r in range(1, 10)] + [(3, r) for r in [*range(1, 10), 9]] + [(4, r) for r in range(1, 12)]
    got = P.whole_units(spark.createDataFrame(rows, "u int, r int"), "u", "r", 1, 10).collect()
    assert [r.u for r in got] == [1]


def test_blind_cases_are_numbered(spark):
    got = P.blind_cases(frame(spark, 300), "profile", "filename", 20, 7).collect()
    assert sorted(r.case_id for r in got) == [f"CASE_{i:03d}" for i in range(1, 61)]


def test_split_has_no_overlap(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "u int")
    assert SE.overlap(ids(1, 2), ids(3), "u").count() == 0
    got = {(r.u, r.side, r.n) for r in SE.reconcile(ids(1, 2, 2), ids(2, 5), "u").collect()}
    assert got == {(1, "MISSING", 1), (2, "MISSING", 1), (5, "UNEXPECTED", 1)}


def test_duplicates_and_coverage_raise(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="duplicate"):
        I.require_empty(I.duplicate_keys(df, "k"), "duplicate keys")
    I.require_empty(I.missing_from(df, {"self": df}, "k"), "coverage")


def test_published_rates(spark):
    n = spark.range(120)
    assert abs(R.zero_failure_bound(n, F.col("id") < 0).first().upper_bound - 0.0247) < 5e-5
    m = spark.createDataFrame([("MATCH",)] * 57 + [("MISMATCH",)] * 2 + [("UNEVALUABLE",)], "m string")
    assert R.accuracy(m, "m").first().accuracy == round(57 / 59, 6)
    final = spark.createDataFrame([("ALL", s) for s, k in (("CONFORMING", 2676), ("NONCONFORMING", 405), ("UNEVALUABLE", 19), ("UNEVALUABLE_SPEC_CONFLICT", 20)) for _ in range(k)], "p string, s string")
    r = R.evaluable_rates(final, "p", "s").first()
    assert round(100 * r.rate_evaluable, 4) == 86.8549 and r.n_conforming + r.n_nonconforming == 3081


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), ("a", 0)], "g string, x int").withColumn("h", F.lit(1))
    got = {(r.level, r.g, r.h): r.n for r in R.grouped_sets(df, [["g"], ["h"]], [F.count(F.lit(1)).alias("n")]).collect()}
    assert got == {("g", None, None): 1, ("g", "a", None): 2, ("h", None, 1): 3}


def test_csv_mark_and_optional_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿filename,note\na,"1, ""2"""\n', encoding="utf-8")
    df = W.read_csv_bom(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["filename", "note"] and df.first().note == '1, "2"'
    W.write_tables({"images": spark.range(2)}, str(tmp_path / "t"))
    got = W.read_required(spark, str(tmp_path / "t"), ["images"], {"scatter": "filename string"})
    assert got["scatter"].count() == 0 and got["scatter"].columns == ["filename"]


def test_jsonl_keeps_rejects(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"unit_id": "BI_001", "prompt_text": "x"}\n\n[1]\n{"unit_id": \n"text"\n')
    valid, rejects = J.read_jsonl(spark, str(tmp_path / "p.jsonl"), "unit_id string, prompt_text string")
    assert [r.unit_id for r in valid.collect()] == ["BI_001"] and rejects.count() == 3


def test_question_file_and_color_config(spark, tmp_path):
    (tmp_path / "q.json").write_text('{\n"BI": [{"id": "BI-01", "pergunta": "?", "resposta": "1"}],\n"BC": []}')
    assert [tuple(r) for r in J.read_profile_json(spark, str(tmp_path / "q.json")).collect()] == [("BI", "BI-01", "?", "1")]
    (tmp_path / "c.json").write_text('{"palette_F": {"azul": "#1F4FD8"}, "expected_colors_by_profile": {"BI": ["azul"], "BC": ["rosa"]}}')
    with pytest.raises(ValueError, match="palette"):
        J.read_color_config(spark, str(tmp_path / "c.json"), ["BI", "BC"])


def test_resume_and_repair(spark, tmp_path):
    todo = spark.range(10).withColumnRenamed("id", "k")
    first = todo.where("k < 4")
    run = str(tmp_path / "run")
    first.withColumn("child", F.lit(1)).write.parquet(f"{run}/children/batch=a")  # an attempt that broke before its parents
    for _ in range(2):
        INC.append_batch(first.withColumn("child", F.lit(1)), first, run, "a")
    assert spark.read.parquet(f"{run}/children").count() == 4
    assert INC.remaining(todo, spark.read.parquet(str(tmp_path / "run" / "parents")), "k").count() == 6
    log = spark.createDataFrame([(1, 1, "ERR"), (1, 2, "OK"), (2, 1, "ERR")], "k int, seq int, s string")
    assert {(r.k, r.s) for r in INC.last_attempts(log, "k", "seq").collect()} == {(1, "OK"), (2, "ERR")}
    assert [r.k for r in INC.open_errors(log.where("s = 'ERR'"), log.where("s = 'OK'"), "k").collect()] == [2]
    cur = spark.createDataFrame([(1, "a", "n"), (2, None, "m")], "k int, u string, note string")
    bad = INC.needs_repair(cur, "u", F.lit("a"))
    assert [r.k for r in bad.collect()] == [2]
    fixed = INC.merge_repaired(cur, bad.select("k", F.lit("a").alias("u")), "k")
    assert {(r.k, r.u, r.note) for r in fixed.collect()} == {(1, "a", "n"), (2, "a", None)}


def test_stream_hands_over_each_file_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    df.write.mode("append").parquet(src)

    def sink(batch, _):
        seen.append(sorted(r.k for r in batch.collect()))

    for _ in range(2):
        INC.stream_new_files(spark, src, df.schema, str(tmp_path / "cp"), "k", sink).awaitTermination()
    spark.createDataFrame([(3, "c")], "k int, v string").write.mode("append").parquet(src)
    INC.stream_new_files(spark, src, df.schema, str(tmp_path / "cp"), "k", sink).awaitTermination()
    assert [s for s in seen if s] == [[1, 2], [3]]


def test_stream_drops_keys_that_return(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sink = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    done = lambda i: spark.read.parquet(out).where(F.col("batch") < i) if i else None
    for rows in ([(1, "a"), (2, "b")], [(2, "again"), (3, "c")], [(1, "again")]):
        df = spark.createDataFrame(rows, "k int, v string")
        df.coalesce(1).write.mode("append").parquet(src)
        INC.stream_new_files(spark, src, df.schema, str(tmp_path / "cp"), "k", sink, done, files=1).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_integration_refuses_doubled_and_missing_keys(spark):
    frame = lambda *ks: spark.createDataFrame([(k, k * 10) for k in ks], "k int, v int")
    universe, review = frame(1, 2).select("k"), frame(1).withColumnRenamed("v", "r")
    good = frame(1, 2).withColumnRenamed("v", "a")
    assert I.integrate(universe, {"a": good}, review, "k").count() == 2
    for bad in (frame(1), frame(1, 2, 2), frame(1, 2, 3)):
        with pytest.raises(ValueError, match="doubled or missing"):
            I.integrate(universe, {"a": bad.withColumnRenamed("v", "a")}, review, "k")
    with pytest.raises(ValueError):
        I.integrate(universe, {"a": good}, review.union(review), "k")


def test_case_numbers_widen(spark):
    df = spark.range(1200).selectExpr("id as k", "id % 2 as s")
    ids = [r.case_id for r in P.blind_cases(df, "s", "k", 600, 1).collect()]
    assert len(set(ids)) == 1200 and "CASE_001" in ids and "CASE_1200" in ids


def test_hash_actions(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, t string")
    old = spark.createDataFrame([("b", "2"), ("c", "x")], "k string, t string")
    got = {r.k: r.action for r in W.emit_by_hash(new, old, "k", "t", overwrite=False).collect()}
    assert got == {"a": "CREATED", "b": "UNCHANGED", "c": "CONFLICT"}
