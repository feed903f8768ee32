import random

from pyspark.sql import functions as F

from gaugeframe.functions.similarity import cosine, indel_similarities, indel_similarity, lcs_length, lcs_lengths
from gaugeframe.operators import score_export as X
from gaugeframe.operators import similarity as S


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_of_whole_texts():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abcé𝔸 ") for _ in range(rng.randrange(0, 90)))
        b = "".join(rng.choice("abcé𝔸 ") for _ in range(rng.randrange(0, 150)))
        assert lcs_length(a, b) == dp(a, b)
    assert indel_similarity("", "") == 1.0 and indel_similarity("a", "") == 0.0 and indel_similarity("Abc", "abc") == 4 / 6


def test_lcs_of_many_pairs_at_once():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcé𝔸 ") for _ in range(n))
    sizes = [0, 1, 2, 7, 63, 64, 65, 66, 130, 200]
    pairs = [(text(rng.choice(sizes)), text(rng.choice(sizes))) for _ in range(400)] + [("a" * 64, "a" * 300), ("a" * 64, "b" * 64)]
    assert lcs_lengths(pairs).tolist() == [dp(a, b) for a, b in pairs]
    assert len(lcs_lengths([])) == 0
    mixed = [*pairs, *pairs[:5], ("", ""), (None, "a"), ("x", None), (None, None)]
    got = indel_similarities(mixed)
    want = [indel_similarity(a, b) for a, b in mixed]
    assert all((g != g) if w is None else g == w for g, w in zip(got, want))


def test_components_and_scores(spark):
    toks = [(1, 0, "Total", 5, 0.1, 0.01), (1, 1, "by", 50, 0.2, 0.02), (1, 2, "Nomes das Medidas", 1100, 0.9, 0.5), (1, 3, "Operação", 1100, 0.92, 0.55), (1, 4, "Industria", 300, 0.3, 0.95),
            (1, 5, "Agropecuaria", 100, 0.1, 0.95), (1, 6, "Setor BNDES", 500, 0.5, 0.97), (1, 7, "R$ 1,5", 500, 0.5, 0.5), (2, 0, "nothing", 500, 0.5, 0.5)]
    df = spark.createDataFrame(toks, "k int, pos int, text string, x int, x_norm double, y_norm double")
    got = {r.k: r for r in S.components(df, "k").collect()}
    assert (got[1].title, got[1].legend, got[1].categories, got[1]["values"], got[1].x_axis) == ("Total by", ["Operação"], ["Agropecuaria", "Industria"], ["R$ 1,5"], "Setor BNDES")
    assert (got[2].title, got[2].legend, got[2].x_axis) == ("", [], "")
    comp = S.components(df, "k").withColumn("task", F.lit("B-ID"))
    ref = comp.where("k = 1").withColumn("compare_values", F.lit(True))
    scores = {r.k: r.ocr for r in S.text_scores(comp, ref, "task").collect()}
    assert scores == {1: 1.0, 2: 0.0}
    no_values = {r.k: r for r in S.text_scores(comp, ref.withColumn("compare_values", F.lit(False)), "task").collect()}
    assert no_values[2].s_values is None and no_values[1].ocr == 1.0


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(r[0].c - 2**-0.5) < 1e-12 and r[1].c is None


def test_export_rounds_rows_before_means(spark):
    rows = [("p", "A", "T", 0.125, 0.5), ("p", "A", "T", 0.135, None), ("p", "B", "T", None, 0.1)]
    s = X.participant_summary(spark.createDataFrame(rows, "participant string, condition string, task string, ocr double, clip double"))
    got = {r.condition: (r.ocr, r.clip) for r in s.collect()}
    assert got == {"A": (0.13, 0.5), "B": (None, 0.1)}
    assert X.score_pivot(s, "ocr", ["A", "B"], ["T"]).first().asDict() == {"participant": "p", "A_T": 0.13, "B_T": None}
