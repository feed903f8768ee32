from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.operators import multiset as M
from gaugeframe.operators import tick_compare as TC

LISTS = st.lists(st.sampled_from("abc"), max_size=6)


def long(spark, lists):
    return spark.createDataFrame([(k, v) for k, vs in enumerate(lists) for v in vs] or [(-1, "z")], "k int, v string").where("k >= 0")


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LISTS, LISTS), min_size=20, max_size=60))
def test_against_counter(spark, pairs):
    counts = M.value_counts(long(spark, [e for e, _ in pairs]), long(spark, [o for _, o in pairs]), ["k"], "v")
    got = {r.k: r for r in M.compare(counts, ["k"], "v").collect()}
    for k, (e, o) in enumerate(pairs):
        if not e and not o:
            assert k not in got
            continue
        ce, co = Counter(e), Counter(o)
        missing, extra = sorted((ce - co).elements()), sorted((co - ce).elements())
        assert got[k].missing_items == " | ".join(missing) and got[k].extra_items == " | ".join(extra)
        want = "NORMALIZED_EQUIVALENT" if ce == co else "NONCONFORMING_MISSING" if not extra else "NONCONFORMING_EXTRA" if not missing else "NONCONFORMING_VALUE"
        assert got[k].detailed == want


def test_decision_table(spark):
    rows = [
        (1, "categorical", "EXAMPLES_ONLY", "READY_X", "YES", "NOT_EVALUATED"), (2, "categorical", "EXHAUSTIVE", "REVIEW_A", "YES", "UNEVALUABLE_SPEC_REVIEW"),
        (3, "categorical", "EXHAUSTIVE", "ANY", "NO", "UNEVALUABLE"), (4, "categorical", "EXHAUSTIVE", "ANY", "YES", "NORMALIZED_EQUIVALENT"),
        (5, "temporal", "EXHAUSTIVE", "READY_TEMPORAL", "YES", "UNEVALUABLE"), (6, "temporal", "EXHAUSTIVE", "READY_LIST", "YES", "NOT_EVALUATED"),
        (7, "numeric", "EXHAUSTIVE", "READY_LIST", "NO", "NONCONFORMING_VALUE"), (8, "numeric", "NOT_SPECIFIED", "REVIEW_A", "YES", "NOT_EVALUATED"),
        (9, "numeric", "EXHAUSTIVE", "DRAFT", "YES", "NOT_EVALUATED"), (10, "categorical", "EXHAUSTIVE", "ANY", "YES", "NONCONFORMING_MISSING"),
    ]
    axes = spark.createDataFrame([r[:5] for r in rows], "k int, kind string, scope string, status string, eligible string")
    expected = spark.createDataFrame([(4, "a"), (7, "a"), (10, "a")], "k int, v string")
    observed = spark.createDataFrame([(4, "a"), (7, "b")], "k int, v string")
    got = {r.k: r for r in TC.compare_axes(axes, expected, observed, "k", "v").collect()}
    assert {k: r.bb_detailed_status for k, r in got.items()} == {r[0]: r[5] for r in rows}
    assert [got[k].denominator_eligible for k in (3, 4, 7, 9)] == ["NO", "YES", "YES", "NO"]


def test_kind_summary_keeps_empty_kinds(spark):
    axes = spark.createDataFrame([(1, "numeric", "EXHAUSTIVE", "READY_A", "YES")], "k int, kind string, scope string, status string, eligible string")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    got = {r.kind: (r.n_rows, r.eligible, r.conformity_rate) for r in TC.summary_by_kind(TC.compare_axes(axes, one, one, "k", "v")).collect()}
    assert got == {"categorical": (0, 0, None), "temporal": (0, 0, None), "numeric": (1, 1, 1.0)}


def test_hot_key_is_counted_not_collected(spark):
    e = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") % 5).cast("string").alias("v"))
    got = M.compare(M.value_counts(e, e, ["k"], "v"), ["k"], "v").first()
    assert (got.n_expected, got.n_missing, got.detailed) == (20000, 0, "NORMALIZED_EQUIVALENT")


def test_report_by_hand(spark):
    """One row of each input; columns as the report names them."""
    from gaugeframe.operators import tick_compare as TC

    spec = spark.createDataFrame([
        (1, "X", "EXHAUSTIVE", "READY_LIST", "A e B", "infraestrutura e 1 | sul", "ASCENDING"), (1, "Y", "EXHAUSTIVE", "READY_LIST", "F", "1000 | 2.5% | 2.5%", "ASCENDING"),
        (2, "X", "EXHAUSTIVE", "READY_TEMPORAL", "T", "2001 | 2002", None), (2, "Y", "EXAMPLES_ONLY", "READY_LIST", "E", "1", None),
    ], "unit_id int, axis string, scope string, status string, display string, canonical string, x_order string")
    cat = spark.createDataFrame([("c1", "P", 1, "Z", "AUTO", "COMPLETE", "Infra-Estrutura / 1 | Norte | SUL", "YES"), ("c2", "P", 1, "Z", "AUTO", "PARTIAL", "x", "NO"), ("c3", "P", 9, "Z", "AUTO", "COMPLETE", "no specification", "YES")],
                                "filename string, profile string, unit_id int, condition string, extraction_source string, ba_final_status string, content string, eligible string")
    final = spark.createDataFrame([("n1", "y", "numeric", "P", 1, "Z", "1 mil | 2,5%", "OK", None, None), ("n2", "Y", "numeric", "P", 1, "Z", "", None, None, None), ("t1", "x", "temporal", "P", 2, "Z", None, "OK", "2002 |  | 2001", None),
                                   ("t2", "X", "temporal", "P", 2, "Z", None, None, None, None), ("e1", "Y", "numeric", "P", 2, "Z", "1", None, None, None), ("k1", "X", "categorical", "P", 1, "Z", None, None, None, None)],
                                  "filename string, axis string, kind string, profile string, unit_id int, condition string, manual string, manual_result string, years string, selected string")
    axes = spark.createDataFrame([("n2", "Y", "5 mil", "1000 | x | 7.25")], "filename string, axis string, raw string, effective string")
    got = {r.filename: r for r in TC.tick_report(spec, cat, final, axes).collect()}
    show = lambda f: (got[f].ba_source, got[f].ba_final_status, got[f].observed_display, got[f].observed_canonical, got[f].bb_detailed_status, got[f].missing_items, got[f].extra_items)
    assert set(got) == {"c1", "c2", "n1", "n2", "t1", "t2", "e1"}
    assert show("c1") == ("AUTO", "COMPLETE", "Infra-Estrutura / 1 | Norte | SUL", "infraestrutura e 1 | norte | sul", "NONCONFORMING_EXTRA", "", "norte")
    assert show("c2") == ("AUTO", "PARTIAL", "x", "", "UNEVALUABLE", "", "")
    assert show("n1") == ("MANUAL_ADJUDICATED", "OBSERVED_COMPLETE", "1 mil | 2,5%", "1000 | 2.5%", "NONCONFORMING_MISSING", "2.5%", "")
    assert show("n2") == ("AUTO_VALIDATED", "OBSERVED_COMPLETE", "", "1000 | 7.25", "NONCONFORMING_VALUE", "2.5% | 2.5%", "7.25")
    assert show("t1") == ("AUTO_OR_MANUAL", "OK", "2002 | 2001", "2002 | 2001", "NORMALIZED_EQUIVALENT", "", "")
    assert show("t2") == ("AUTO_OR_MANUAL", "", "", "", "UNEVALUABLE", "", "")
    assert show("e1") == ("", "", "", "", "NOT_EVALUATED", "", "")
    assert (got["c1"].f_order_required, got["n1"].f_order_required, got["n1"].f_expected_display, got["n1"].f_expected_canonical) == ("ASCENDING", "NOT_SPECIFIED", "F", "1000 | 2.5% | 2.5%")
