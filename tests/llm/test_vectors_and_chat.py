"""Exact search and chat formatting against plain Python on small fixtures."""

import hashlib
import math
import random

import numpy as np
import pytest

import gaugeframe.llm.chat as chat
import gaugeframe.llm.topk as topk
from gaugeframe.llm.chat import digests, format_conversations, parse
from gaugeframe.llm.topk import approximate, search, top_k

NAN, INF = float("nan"), float("inf")


def brute_top(rows, asked, k):
    clean = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in sorted(clean):
        if q in asked:
            scores = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v)})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def test_top_k_with_ties_nulls_and_copies(spark):
    r = random.Random(0)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5]) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 340)]
    rows += [(400, None), (401, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (402, [NAN] * 6), (403, [INF] * 6), (None, [0.5] * 6), (7, rows[7][1]), (500, [0.1, 0.2]), (550, [0.3, 0.2]), (600, [])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, score string")
    got = top_k(df, df.where("vec_id % 50 = 0"), k=5, block=64, query_block=4)
    asked = {i for i, _ in rows if i is not None and i % 50 == 0}
    assert sorted(map(tuple, got.collect())) == brute_top(rows, asked, 5)
    assert top_k(df.where("false"), df.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1e9 + i, 3e8 * i]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id = 0"), k=3, scale=1)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(i, (10**9 + i) * 10**9) for i in (5, 4, 3)]


def test_blocks_of_vectors_are_not_broadcast(spark, monkeypatch):
    """Repeated for every block of the other side, small tables made a broadcast of gigabytes."""
    monkeypatch.setattr(topk, "MEET", 2000, raising=False)
    r = random.Random(1)
    rows = [(i, [r.uniform(-0.6, 0.6) for _ in range(8)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).cache()
    got = top_k(df, df.where("vec_id % 3 = 0"), k=5, block=32, query_block=16)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    exact = [(i, v) for i, v in map(tuple, df.collect())]
    assert sorted(map(tuple, got.collect())) == brute_top(exact, set(range(0, 900, 3)), 5)


def test_vectors_of_one_id_that_score_the_same_are_one_partner(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [0.5, 0.01 * i]) for i in range(9)] + [(i, [0.25, 0.0]) for i in range(8, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id = 0"), k=4)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 7, 128 * 256), (0, 2, 8, 64 * 256), (0, 3, 9, 64 * 256), (0, 4, 10, 64 * 256)]


@pytest.mark.parametrize("kind", ["even", "outliers", "sparse", "equal", "huge", "few"])
def test_bounds_lose_no_neighbour(kind):
    r = np.random.default_rng(2)
    x = r.normal(0, 40, (3000, 24)).astype(np.int64)
    if kind == "outliers":
        x[::211] *= 10**6
        x[5, 3] = 10**9
    elif kind == "sparse":
        x[r.random(x.shape) < 0.97] = 0
    elif kind == "equal":
        x[:] = r.integers(-1, 2, (3000, 1))
    elif kind == "huge":
        x *= 10**6
        x[::50] *= 31
    elif kind == "few":
        x = x[:4]
    ids = r.permutation(len(x))
    files = [(ids[i : i + 700], x[i : i + 700], *approximate(x[i : i + 700])) for i in range(0, len(x), 700)]
    best = search(ids[::5], x[::5], files, 5, 256)
    for n, i in enumerate(range(0, len(x), 5)):
        scores = sorted((-s, j) for j, s in zip(ids.tolist(), (x.astype(object) @ x[i].astype(object)).tolist()) if j != ids[i])[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[n, : best.have[n]], best.ids[n])] == scores


TURNS = [
    (1, 0, "user", "Hi <|x|> </s>[INST] ok [/INST]"), (1, 1, "assistant", "é\\ <\\/ [\\I <"), (1, 2, "user ", "["), (2, 0, "assistant", None), (2, None, None, "early"), (3, 5, "assistant", ""),
    (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a"), (None, 0, "user", "no id"), (4, 0, "[INST] assistant", "</s>"), (5, 0, "user", "long " * 30000),
]


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_chat_round_trip(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, loss int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2" if block == 1 else "10000")
    try:
        formatted = format_conversations(df)
        got = {r.conv_id: r for r in digests(formatted).collect()}
        texts = {r.conv_id: r.formatted for r in formatted.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = lambda x: (x is not None, x or "")
    for c in {t[0] for t in TURNS}:
        turns = sorted((t for t in TURNS if t[0] == c), key=lambda t: ((t[1] is not None, t[1] or 0), first(t[2]), first(t[3])))
        plain = [(r or "", x or "") for _, _, r, x in turns]
        learned = "".join(x for r, x in plain if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert parse(texts[c]) == plain
        assert tuple(got[c]) == (c, len(plain), sha("".join(f"{r}\n{x}\n" for r, x in plain)), len(learned), sha(learned), len(texts[c]))
    assert format_conversations(df.where("false")).count() == 0
