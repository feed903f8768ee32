"""Archives, conversation tries and hard negatives against plain Python on small fixtures."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import gaugeframe.llm.hard_negatives as hard
import gaugeframe.llm.prefix_trie as trie
from gaugeframe.llm.common import shared_folder
from gaugeframe.llm.hard_negatives import Packed, mine_negatives
from gaugeframe.llm.prefix_trie import KEY, digest_turns, graft, list_digests, prefix_trie
from gaugeframe.llm.queries import op12_prefix_trie
from gaugeframe.llm.warc import parse, ranges, read_records, record, write_archives
from gaugeframe.operators.scan import spread_join as plain

LONG = "ü" * 500  # 1000 bytes
PAGES = [
    (1, "http://a/1", LONG), (7, "http://a/7", LONG), (3, "http://a/3 x\r\ny", LONG), (None, None, LONG), (2, "http://b", "short"), (4, "http://b", "short"), (5, None, None), (6, "u", ""),
    (8, "u8", "a" * 999), (9, "u9", "a" * 999), (10, "é", "b\r\n\r\nc" * 300), (11, "x", "long " * 50000), (12, "first", "tie " * 300), (12, "second", "tie " * 300),
    *[(13, "same", "again " * 200)] * 3, (12, "again", "again " * 200), (None, "n", "null ids " * 200), (None, "m", "null ids " * 200),
]


def test_archives(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int")
    index = write_archives(df, shared_folder(spark, "archives"), most=2000)
    records = read_records(index).collect()
    want = []
    rows = [(i, u, (h or "").encode()) for i, u, h in PAGES]
    first = lambda x: (x is not None, x or 0)
    for at, (i, _, body) in enumerate(rows):
        same = [k for k, r in enumerate(rows) if r[2] == body] if len(body) >= 1000 else [at]
        top = max(same, key=lambda k: (first(rows[k][0]), (rows[k][1] is not None, rows[k][1] or ""), -k))
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if top == at else "revisit", None if top == at else rows[top][0]))
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=key) == sorted(want, key=key)
    stored = {r.payload_digest: bytes(r.payload) for r in records if r.record_type == "response"}
    assert {hashlib.sha1(b).hexdigest() for _, _, b in rows} == set(stored) and all(hashlib.sha1(p).hexdigest() == d for d, p in stored.items())
    assert len({r.record_id for r in records}) == len(PAGES) and index.select("path").distinct().count() > 3
    # some records, chosen in the index
    some = read_records(index.where("url = 'first'")).collect()
    assert [r.target_uri for r in some] == ["urn:none"] or [r.target_uri for r in some] == ["first"]
    assert write_archives(df.where("false"), shared_folder(spark, "archives")).count() == 0


def test_a_revisit_names_its_response(spark):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    index = write_archives(df, shared_folder(spark, "archives"))
    data = {}
    for r in index.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            data[r.page_id] = parse(zlib.decompress(f.read(r.length), 31))
    assert {p: f["warc-refers-to"] for p, (f, _, _) in data.items() if p != 7} == dict.fromkeys((1, 3, None), data[7][0]["warc-record-id"])
    assert data[3][0]["warc-target-uri"] == "http://a/3%20x%0D%0Ay" and data[None][0]["warc-refers-to-target-uri"] == "http://a/7"
    assert data[1][2] == b"" and data[1][1]["content-length"] == "1000" and data[7][2] == LONG.encode()


def test_damage_is_found(spark):
    with pytest.raises(ValueError):
        parse(record("response", "<urn:x>", "2000-01-01T00:00:00Z", "u", "00" * 20, 3, b"abc", 1)[:-1])


def test_ranges():
    at, size = np.array([0, 10, 20, 100, 110, 0]), np.array([10, 10, 10, 10, 60, 5])
    assert ranges(["a"] * 5 + ["b"], at, size, gap=5, most=1000) == [(0, 3), (3, 5), (5, 6)]
    assert ranges(["a"] * 5 + ["b"], at, size, gap=500, most=30) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert ranges([], np.array([]), np.array([]), 1, 1) == []


# ---------------------------------------------------------------------------------------- tries
def brute_trie(rebuilt):
    paths = {c: [tuple(t[:d]) for d in range(len(t) + 1)] for c, t in rebuilt.items()}
    nodes = {}
    for c, ps in paths.items():
        for p in ps:
            nodes.setdefault(p, []).append(c)
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(n) + 1)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuild(rows):
    none_first = lambda x: (x is not None, x or 0)
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: none_first(r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}


SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 int, w int"


def made_conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 160), *range(200, 230), -7, -100, 305]:
        n = 40 if c == 9 else r.choice([1, 1, 2, 3, 5, 7])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", r.choice(["a", "é b", "", "same opening"])) for t in range(n)]
    rows += [(2, None, None, "early"), (2, 99, "user", None), (None, 0, "user", "no id")]
    rows += [(c, t, "user", "hot") for c in range(5000, 5300) for t in range(8)]
    return rows


@pytest.mark.parametrize("share", [1000, 3])
def test_trie(spark, share, monkeypatch):
    monkeypatch.setattr(trie, "spread_join", lambda *a, **k: plain(*a, **k, share=share))
    rows = made_conversations()
    df = spark.createDataFrame([(*t, "clash", 3, 4) for t in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50" if share == 3 else "10000")
    try:
        nodes, ends = prefix_trie(*graft(digest_turns(df)))
        got = nodes.join(list_digests(ends, KEY, "conv_id", "sha"), KEY, "left").fillna(hashlib.sha256(b"").hexdigest(), ["sha"])
        got = [tuple(t) for t in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_trie(brute_rebuild(rows))
    key = lambda t: (t[1], t[0], t[7])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op12_prefix_trie(spark, str(tmp_path)).count() == 0
    # repeated and tied turns have one order
    df = spark.createDataFrame([(c, 0, "user", t, "", 0, 0) for c in (8, 9) for t in ("x", "y", "y")], SCHEMA)
    nodes, _ = prefix_trie(*graft(digest_turns(df), most=1))
    assert sorted((r.depth, r.n_convs) for r in nodes.collect()) == [(0, 2), (1, 2), (2, 2), (3, 2)]


# ------------------------------------------------------------------------------------- negatives
@pytest.mark.parametrize("top", [3, 300, 2**20, 2**40])
def test_packed_products_are_exact(top):
    r = np.random.default_rng(0)
    x, a = r.integers(-top, top, (37, 16)), r.integers(-top // 3, top, (5, 16))
    got = Packed(x, a.min(), a.max()).scores(a)
    assert (got.astype(object) == a.astype(object) @ x.T.astype(object)).all()
    assert Packed(x[:0], 0, 1).scores(a[:0]).shape == (0, 0) and (Packed(np.zeros((3, 0), np.int64), 0, 0).scores(np.zeros((2, 0), np.int64)) == 0).all()


def brute_negatives(rows):
    clean = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, lab, v in clean:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in clean if j != i and len(w) == len(v))
        for s, p, _ in [t for t in scored if t[2] == lab][:5]:
            near = [(n, j) for n, j, other in scored if other != lab and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(near)]
    return sorted(out)


def test_negatives(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(3), [r.choice([-0.25, 0.1, 0.5, 0.9]) for _ in range(6)]) for i in range(700)] + [(i, 1, [0.9] * 6) for i in range(700, 760)]
    rows += [(800, None, [0.9] * 6), (801, 1, None), (802, 1, [None] + [0.5] * 5), (900, 2, [float("nan")] * 6), (None, 1, [0.5] * 6), (300, rows[300][1], rows[300][2]), (1000, 1, [0.5, 0.5]), (1001, 1, [0.5, 0.6]), (1002, 0, [0.5, 0.5]), (1100, 0, []), (1200, 5, [-0.9] * 6)]
    df = spark.createDataFrame([(*x, "clash", 0) for x in rows], "vec_id long, label int, embedding array<double>, score string, block int")
    for sizes in ({"block": 64, "anchor_block": 3}, {}):
        assert sorted(map(tuple, mine_negatives(df, **sizes).collect())) == brute_negatives(rows)
    assert mine_negatives(df.where("false")).count() == 0 and mine_negatives(df.where("vec_id = 100")).count() == 0
    assert mine_negatives(df.where("label = 1")).count() == 0


def test_blocks_of_anchors_are_not_broadcast(spark, monkeypatch):
    """Repeated for every block of vectors, small tables of anchors made a broadcast of gigabytes."""
    monkeypatch.setattr(hard, "MEET", 3000, raising=False)
    r = random.Random(3)
    rows = [(100 * i if i < 40 else 10**4 + 7 * i + 1, r.randrange(3), [r.uniform(-0.6, 0.6) for _ in range(5)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").cache()
    got = mine_negatives(df, block=32, anchor_block=8)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") < 2  # one is that of the positives' scores
    assert sorted(map(tuple, got.collect())) == brute_negatives([tuple(x) for x in df.collect()])


def test_wide_integers_give_the_same(monkeypatch):
    monkeypatch.setattr(hard, "EXACT_BITS", 0)
    a, b = np.array([[5, -3]]), np.array([[1, 2], [-9, 4]])
    assert Packed(b, -3, 5).kind is object and Packed(b, -3, 5).scores(a).tolist() == [[-1, -57]]
