import unicodedata

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import numbers as N
from gaugeframe.functions import status as S
from gaugeframe.functions import text as T
from gaugeframe.operators import tick_compare as TC


def values(spark, rows, expr, ddl="c string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], ddl).select(expr.alias("x")).collect()]


def test_half_even_rounding(spark):
    assert values(spark, [2.5, 0.5, 3.5, None], N.rint_round(F.col("c"), 0), "c double") == [2.0, 0.0, 4.0, None]
    assert values(spark, ["nan", "x", "1.5", None], N.safe_float(F.col("c"))) == [None, None, 1.5, None]


def test_truth_words(spark):
    assert values(spark, ["1", "1.0", " SIM ", "", None, "ok"], T.truthy(F.col("c"))) == [True, False, True, False, False, True]
    assert values(spark, ["Não", "0", "", None], T.falsey(F.col("c"))) == [True, True, False, False]


def test_accents_follow_compatibility_decomposition(spark):
    words = ["Infra-Estrutura", "Comércio / Serviços", "é", "x²", "ﾊ", "№", "ﬁ", "naïve ½", None, "ÀÇÑ ß", "ﬁnal ½ ① ㎏ ℃", "ﬃ㍿…", "e\u0301 ｆｕｌｌ", "𝐀𝟙", ""]
    got = values(spark, words, T.strip_accents(F.col("c")))
    for w, g in zip(words, got):
        assert g == (None if w is None else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)))
    assert values(spark, ["Comércio / Serviços", " INFRA-estrutura "], T.cat_label(F.col("c"))) == ["comercio e servicos", "infraestrutura"]


@pytest.mark.parametrize(
    "raw,value,full",
    [("10%", 10.0, 10.0), ("R$ 12,5", 12.5, 12.5), ("1,234", 1234.0, 1234.0), ("(3K)", 3.0, 3000.0), ("l0", 10.0, 10.0), ("O5", 5.0, 5.0), ("2.5M", 2.5, 2.5e6),
     ("5MI", None, None), ("1.234,56", None, None), ("ER0BEE", None, None), ("", None, None), ("abc", None, None)],
)
def test_numeric_token(spark, raw, value, full):
    t = values(spark, [raw], T.numeric_token(F.col("c")))[0]
    assert (t.value, t.full) == (value, full) if value is not None else t is None


def test_scale_text(spark):
    got = values(spark, ["1e8", "Ie8", "x10^6", "10^-3", "1E+O3", "10B", "1e8 m", "abc"], T.scale_exponent(F.col("c")))
    assert got == [8, 8, 6, -3, 3, None, None, None]


def test_general_number_matches_percent_g(spark):
    nums = [0.5, 12.0, 1234567.5, 2.685075e-06, 0.0001234567, 123456.7, -2.25, 1e15]
    want = [str(int(round(v))) if abs(v - round(v)) < 1e-9 else f"{v:g}" for v in nums]
    assert values(spark, nums, T.general_number(F.col("c")), "c double") == want


def test_evidence(spark):
    text = ["A=1;B=x;note;A=2;C=.5", "", None, "A=3;A=bad"]
    assert values(spark, text, S.evidence_map(F.col("c")))[0] == {"A": 2.0, "C": 0.5}
    assert values(spark, text, S.evidence_value(F.col("c"), "A")) == [2.0, 0.0, 0.0, 3.0]


def test_image_names(spark):
    cols = S.parse_image_name(F.col("c"))
    rows = spark.createDataFrame([("bi_001_R02.PNG",), ("BI_1_R02.png",), ("SC_037_R10.jpeg",)], "c string").select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert [r.unit_id for r in rows] == ["BI_001", None, "SC_037"]
    assert [r["repeat"] for r in rows] == [2, None, 10] and [r.name_valid for r in rows] == [1, 0, 1]


def test_unreviewed_exception_stays_pending(spark):
    d = S.presence_decision(F.lit("0"), F.lit("0"), F.lit(None).cast("string"))
    r = spark.range(1).select(d.alias("d")).first().d
    assert (r.status, r.source) == (S.PENDING, "AUTO_EXCEPTION")


def test_overall_precedence(spark):
    def word(*dims):
        return spark.range(1).select(S.overall_strict([F.lit(d).cast("string") for d in dims]).alias("x")).first().x

    assert word(S.C, S.C, "NOT_SPECIFIED") == S.C
    assert word(S.C, S.U, S.NC) == S.NC
    assert word(S.C, S.PENDING) == S.U and word(S.C, None) == S.U
    assert word(S.NC, S.U_SPEC) == S.U_SPEC


def test_numeric_reading_precedence(spark):
    rows = [("10 mil | 0", None, None, None), ("12,5 | 0", None, None, "5 k 6 k 7 mil"), ("", "1000 | x", "1", None), ("none", None, "2 | 0", "3M 4 m"), ("", "", "", ""), ("10%", None, None, "5 k")]
    df = spark.createDataFrame(rows, "m string, e string, s string, r string")
    got = [(r.source, [(i.typ, i.value) for i in r["items"]]) for r in TC.observed_numeric(df, "m", "e", "s", "r").collect()]
    assert got == [
        ("MANUAL_ADJUDICATED", [("NUM", 10000.0), ("NUM", 0.0)]),
        ("MANUAL_ADJUDICATED", [("NUM", 12500.0), ("NUM", 0.0)]),
        ("AUTO_VALIDATED", [("NUM", 1000.0)]),
        ("AUTO_FALLBACK", [("NUM", 2000000.0), ("NUM", 0.0)]),
        ("NONE", []),
        ("MANUAL_ADJUDICATED", [("PCT", 10.0)]),
    ]
