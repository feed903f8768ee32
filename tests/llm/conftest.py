import pytest

from gaugeframe.session import ship_package

#: rows that every operator over documents must stand: nulls, empty, repeated rows and ids, very long texts
EDGE = [
    (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "One two three.", None, None, None), (None, "No id here, but text.", "de", "b", 3), (None, None, None, None, None),
    (3, "Same text twice in two rows, same id.", "fr", "a", 5), (3, "Same text twice in two rows, same id.", "fr", "a", 5), (3, "Another text of the same id.", "fr", "a", 5),
    (4, "x" * 5000, "en", "c", 5000), (5, "İstanbul ﬁn ß 日本 😀 <|endoftext|> </s> [INST] \\ <\\", "es", "c", 1), (6, "long tail " * 4000, "en", "a", 40000),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names operators use themselves."""
    rows = [(*r, "clash", 7, [1]) for r in EDGE]
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string, k1 int, spans array<int>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
