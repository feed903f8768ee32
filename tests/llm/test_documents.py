"""Operators over documents against plain Python on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm.chosen_path import components, near_duplicates
from gaugeframe.llm.common import PieceEncoder, blocks, encoder, shared_folder
from gaugeframe.llm.decontaminate import Matcher, find_passages, remove_passages
from gaugeframe.llm.hilbert import curve_index, shard_documents, write_shards
from gaugeframe.llm.packing import Places, cut_documents, pack, plan, widen_ids
from gaugeframe.llm.quality import estimate_prior, fit, score_quality, train
from gaugeframe.llm.queries import QUERIES
from gaugeframe.llm.suffix_dedup import _anchor_rows, deep_shallow, merged, remove_repeats
from gaugeframe.llm.token_counts import count_tokens
from gaugeframe.llm.token_files import TokenFile, read_digests, write_token_files
from gaugeframe.llm.words import BASE, KEPT, powers, raw_bytes

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path):
    r = random.Random(1)
    parts = ["a", "Der", "  ", " ", "\n", "\n\n", "\t", "0", "é", "ß", "́", "'s", "'T", "<|endoftext|>", "!", ",", ".", "\x1c", "\xa0", "Σ", "I", "İ", "日本", "😀", "\r\n", "\x00", "᠎"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    e = PieceEncoder(path, most=50)
    for _ in range(2):
        assert e(texts) == [e._ids(t).tobytes() for t in texts]


# op 1


def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    often = collections.Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        runs = merged([(i, i + size) for i in range(len(t) - size + 1) if often[t[i : i + size]] > 1])
        kept = bytes(c for i, c in enumerate(t) if not any(a <= i < b for a, b in runs))
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def test_deep_shallow_order_and_prefixes():
    r = np.random.default_rng(0)
    for k in range(60):
        n = int(r.integers(1, 60))
        grid = r.integers(0, 2 + k % 2, (n, 64)).astype(np.uint8)
        grid[n // 2 :, :50] = grid[: n - n // 2, :50]
        sizes, group = r.integers(30, 65, n), np.sort(r.integers(0, 4, n))
        for i in range(n):
            grid[i, sizes[i] :] = 0
        order, prefix = deep_shallow(grid, sizes, group)
        keys = [(group[i], grid[i, : sizes[i]].tobytes()) for i in range(n)]
        assert [keys[i] for i in order] == sorted(keys)
        for (g, a), (h, b), p in zip([keys[i] for i in order], [keys[i] for i in order[1:]], prefix[1:]):
            assert p == (next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if g == h else 0)


@pytest.mark.parametrize("seed,hot", [(0, 20_000), (1, 20_000), (2, 4)])
def test_repeats_against_all_windows(spark, seed, hot):
    r = random.Random(seed)
    letters = "abé" if seed else "abcdefgh "
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [make(r.randint(5, 90)) for _ in range(6)]
    texts = [None, "", make(3)]
    for _ in range(50):
        texts.append("".join(r.choice([r.choice(shared), make(r.randint(0, 25)), "x" * r.randint(0, 60)]) for _ in range(r.randint(1, 6))))
        texts += texts[-1:] * (r.random() < 0.15)
    got = remove_repeats(documents(spark, texts), 40, 20, hot=hot).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [tuple(x) for x in got.collect()] == brute_repeats(texts, 40)


def test_a_run_of_one_word_is_few_anchor_rows():
    r = random.Random(3)
    texts = ["ding " * 4000, "".join(r.choice("abcdefgh") for _ in range(5000)), "", "x" * 399]
    batch = pa.record_batch({"k1": pa.array(range(4), pa.int64()), "k2": pa.array([0] * 4, pa.int64()), "text": texts})
    (got,) = _anchor_rows(400, 200, raw_bytes)([batch])
    run = got.filter(pa.array([k == 0 for k in got.column("k1").to_pylist()])).to_pylist()
    # one row for each distance to either end of the text, and one for all places between
    assert len(run) <= 2 * 200 // 5 + 2 and sum(x["times"] for x in run) > 3900
    assert max(x["on"] for x in run) > 19_000 and set(got.column("k1").to_pylist()) == {0, 1}


def test_repeats_of_runs_against_all_windows(spark):
    r = random.Random(5)
    texts = [r.choice(["", "p", "qr"]) + "ding " * r.randint(1, 40) + r.choice(["", "z"]) + "é" * r.randint(0, 60) + "ding" * r.randint(0, 20) for _ in range(40)]
    got = remove_repeats(documents(spark, texts), 60, 30).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [tuple(x) for x in got.collect()] == brute_repeats(texts, 60)


def test_repeats_of_edge_rows(edge, none):
    got = remove_repeats(edge, 400, carry=("lang",))
    found = {(r.doc_id, r.n_bytes): r for r in got.collect()}
    assert got.count() == edge.count() and found[(4, 5000)].n_removed == 5000 and found[(6, 40000)].n_removed == 40000
    assert found[(2, 14)].n_removed == 0 and remove_repeats(none).count() == 0


def test_op1_returns_the_text_that_is_left(spark):
    got = QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got if r.text.isascii())
    assert all(len(r.text.encode()) == r.n_bytes - r.n_removed for r in got if r.text.isascii())


def test_op1_counts_passages_of_over_50_words_that_repeat(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    passage, short, own = [[word() for _ in range(n)] for n in (55, 50, 120)]
    texts = [own[:60] + passage + own[60:], [word() for _ in range(80)] + passage, own[:20] + short, [word() for _ in range(9)] + short, [word() for _ in range(200)]]
    docs = documents(spark, [" ".join(t) for t in texts] + ["", None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    # the passage has fewer than 400 bytes: it stays in the text, by contract
    assert [got[i].n_passages for i in range(7)] == [1, 1, 0, 0, 0, 0, 0] and not any(x.n_removed for x in got.values())


def test_kept_text_has_whole_characters(spark):
    texts = ["é" * 30 + "a", "b" + "é" * 30]
    got = remove_repeats(documents(spark, texts), 41, 20).orderBy("doc_id").collect()
    assert all(set(r.kept) <= set("éab") for r in got)


# op 2


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, train(docs, labels))
    kept = scored.join(labels.select("doc_id", "quality"), "doc_id").where("held_out")
    n, right = kept.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in scored.limit(50).collect())
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(score_quality(docs, train(docs, flipped)), "doc_id", "score") == rows(scored, "doc_id", "score")


def test_quality_of_edge_rows(spark, edge, none):
    labels = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (3, 0), (None, 1), (4, None), (6, 0)], "doc_id long, quality int")
    got = score_quality(edge, train(edge, labels))
    assert got.count() == edge.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert train(none, labels) is None and score_quality(edge, None).where("score <> 0.5").count() == 0 and score_quality(none, None).count() == 0


def test_prior_and_risk_on_known_mixture():
    r = np.random.default_rng(0)
    good, bad = r.normal(2, 1, (3000, 2)), r.normal(-2, 1, (3000, 2))
    mixed = np.concatenate([good[:1000], bad[:2000]])
    model = fit(good[1000:], mixed)
    assert abs(model.prior - 1 / 3) < 0.08
    assert (model.score(r.normal(2, 1, (500, 2))) >= 0.5).mean() > 0.95 and (model.score(r.normal(-2, 1, (500, 2))) < 0.5).mean() > 0.95
    assert 0.01 <= estimate_prior(np.zeros(3), np.zeros(3)) <= 0.99


# op 3


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts_are_the_librarys_and_cached(spark, edge, none, path):
    cache = shared_folder(spark, "test-cache")
    want = []
    if path is PIECES:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        encode = lambda x: t.encode(x, add_special_tokens=False).ids
    for r in edge.collect():
        n = len(encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
    for _ in range(2):
        assert rows(count_tokens(edge, path, cache, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == edge.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert count_tokens(none, path, cache, 100).count() == 0


# op 5


def test_token_files_read_back(spark, edge, none):
    from tokenizers import Tokenizer

    t, folder = Tokenizer.from_file(BYTES), shared_folder(spark, "test-files")
    index = write_token_files(edge, BYTES, folder, length=64)
    order = sorted(edge.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = {}
    for r in order:
        ids.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [0])
    got = read_digests(index).orderBy("start").collect()
    at = 0
    for r in got:
        mine = next(x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(mine)
        assert (r.start, r.n_tokens) == (at, len(mine))
        at += len(mine)
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    first = index.orderBy("start").first()
    file = TokenFile(first.path)
    body, mask = file.sequence(0)
    assert len(body) == len(mask) == 64 and (file.ids(0, 10) == body[:10]).all()
    assert write_token_files(none, BYTES, folder).count() == 0


# op 6


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_goes_from_cell_to_cell(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = curve_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards_are_even_and_gapless(spark, edge, none, shards):
    got = shard_documents(edge, shards).collect()
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge.collect())
    assert shard_documents(none, shards).count() == 0


def test_written_shards_hold_all_rows(spark, edge):
    folder = shared_folder(spark, "test-shards")
    write_shards(shard_documents(edge, 3, carry=("text",)), folder)
    assert spark.read.parquet(folder).count() == edge.count()


# op 7


def test_plan_holds_every_piece_once():
    r = np.random.default_rng(0)
    for room in (16, 128):
        demand = np.bincount(np.minimum(r.lognormal(2, 1, 3000).astype(int) + 1, room), minlength=room + 1)
        sizes = np.flatnonzero(demand)
        found = plan(sizes, demand[sizes], room)
        assert (sum(a * n for a, n in found) == demand[sizes]).all() and all((a * sizes).sum() <= room for a, _ in found)
        assert sum(n for _, n in found) <= np.ceil(sizes @ demand[sizes] / room) * 1.05 + 3


def test_packed_pieces(spark, edge, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = cut_documents(edge, WORDS, capacity=128, keep_ids=True)
    got = pack(pieces, capacity=128, unit=8).collect()
    assert len(got) == pieces.count()
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 128
    assert sorted({r.sequence_id for r in got}) == list(range(max(r.sequence_id for r in got) + 1))
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge.collect())
    assert sorted(r.doc_tokens for r in got if r.start == 0) == want and sum(r.length for r in got) == sum(want)
    assert pack(cut_documents(none, WORDS)).count() == 0


@pytest.mark.parametrize("text", ["", "ok", "a b c"])
def test_short_texts_fill_sequences(spark, text):
    got = pack(cut_documents(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")), WORDS)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r.n == r.m <= 2048 for r in got) and sum(r.n for r in got) >= 0.9 * 2048 * len(got)


@pytest.mark.parametrize("capacity,unit", [(2048, 16), (128, 8), (32, 16), (7, 1)])
def test_places_hold_every_piece_once(capacity, unit):
    r = random.Random(capacity)
    lengths = np.array([min(capacity, 1 + int(r.expovariate(8 / capacity))) for _ in range(3000)])
    places = Places(capacity, unit)
    size = places.size_of(lengths)
    kinds, counts = np.unique(size, return_counts=True)
    places.fit(list(zip(kinds.tolist(), counts.tolist())))
    sequence = np.zeros(len(size), np.int64)
    for s in kinds:
        at = np.flatnonzero(size == s)
        sequence[at] = places.sequence(int(s), np.arange(len(at)))
    load = np.bincount(sequence, weights=lengths)
    assert load.max() <= capacity and load.min() > 0


def test_narrow_ids_are_widened_again(spark, edge):
    wide = cut_documents(edge, WORDS, capacity=128, keep_ids=True)
    narrow = cut_documents(edge, WORDS, capacity=128, keep_ids=True, narrow=True)
    assert all(len(r.ids) == 2 * r.length for r in narrow.collect())
    columns = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
    assert rows(widen_ids(narrow), *columns) == rows(wide, *columns)
    with pytest.raises(Exception, match="16 bits"):
        cut_documents(edge, WORDS, end_id=1 << 16, keep_ids=True, narrow=True).collect()


# op 8


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    near = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) * 10 >= 8 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(sets)))
    while (new := [min([root[i], *(root[j] for j in near[i])]) for i in range(len(sets))]) != root:
        root = new
    return [(i, root[i], len(near[i])) for i in range(len(sets))]


@pytest.mark.parametrize("seed", [0, 1])
def test_links_against_all_pairs(spark, seed, monkeypatch):
    import gaugeframe.llm.chosen_path as c

    if seed:  # so that buckets are split, found dense and compared in parts
        monkeypatch.setattr(c, "LEAF", 8)
        monkeypatch.setattr(c, "BLOCK", 8)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    hot = " ".join(r.choice(vocabulary) for _ in range(30))
    texts = [None, "", "one", "one", "one two three"]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 2, 12])):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(hot + " " + " ".join(r.choice(vocabulary) for _ in range(40)))
    assert [tuple(x) for x in near_duplicates(documents(spark, texts)).orderBy("doc_id").select("doc_id", "class_id", "n_links").collect()] == brute_links(texts)


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_chains_and_shared_passages(spark, seed, monkeypatch):
    """Chains of near copies, whose ends are far apart, and groups that share passages but are no near copies."""
    import gaugeframe.llm.chosen_path as c

    if seed:  # so that buckets are compared in parts
        monkeypatch.setattr(c, "LEAF", 8)
        monkeypatch.setattr(c, "BLOCK", 8)
    r = random.Random(seed + 10)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two"]
    for _ in range(3):
        at = [r.choice(vocabulary) for _ in range(90)]
        for i in range(25):
            at = at[1:] + [r.choice(vocabulary)] if i % 8 else at
            at[r.randrange(90)] = r.choice(vocabulary)
            texts += [" ".join(at)] * r.choice([1, 1, 3])
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts += [" ".join(shared + [r.choice(vocabulary) for _ in range(r.choice([4, 25]))]) for _ in range(30)]
    r.shuffle(texts)
    assert [tuple(x) for x in near_duplicates(documents(spark, texts)).orderBy("doc_id").select("doc_id", "class_id", "n_links").collect()] == brute_links(texts)


def test_links_of_edge_rows(edge, none):
    got = near_duplicates(edge)
    assert got.count() == edge.count() and near_duplicates(none).count() == 0
    assert sorted(r.n_copies for r in got.where("doc_id = 3").collect()) == [1, 2, 2]


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([((0, i), (0, i + 1)) for i in range(20)] + [((1, 5), (1, 3))], "a struct<k1: long, k2: long>, b struct<k1: long, k2: long>")
    got = {tuple(r.node): tuple(r.root) for r in components(pairs).collect()}
    assert got == {(0, i): (0, 0) for i in range(21)} | {(1, 5): (1, 3), (1, 3): (1, 3)}


# op 9


def brute_hits(texts, items, window):
    out = []
    for d in texts:
        x, hit, names = words(d), set(), set()
        for name, t in items:
            y = words(t)
            k = min(window, len(y))
            for i in range(len(y) - k + 1) if k else ():
                for j in range(len(x) - k + 1):
                    if x[j : j + k] == y[i : i + k]:
                        hit |= set(range(j, j + k))
                        names.add(name)
        out.append((len(x), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_hits_against_all_windows(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d9", "ẞ"][: r.randint(2, 5)]
    make = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n"]) for _ in range(n))
    window = r.choice([2, 3, 4, 6])
    items = [(str(i), r.choice(["", make(r.randint(0, 3)), make(r.randint(0, 12))])) for i in range(r.randint(0, 6))]
    texts = [r.choice([None, "", make(r.randint(0, 40)), make(5) + (r.choice(items)[1] if items else "") + make(4)]) for _ in range(8)]
    counts, found = Matcher(items, window).find(pa.array(texts, pa.string()))
    assert [(int(n), sum(b - a + 1 for a, b, *_ in s), sorted(m)) for n, (s, m) in zip(counts, found)] == brute_hits(texts, items, window)


def test_passages_in_parts_and_removed(spark, edge, none):
    items = [(1, "one two three"), (None, "same id"), (2, None), (7, " ".join(f"q{i}" for i in range(30)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text = "before " + " ".join(f"Q{i}" for i in range(5, 20)) + " after, " + "more words " * 20
    docs = edge.select("doc_id", "text").unionByName(documents(spark, [text]).select("doc_id", "text"))
    every = [find_passages(docs, benchmark, part_words=n) for n in (3, 1000)]
    assert rows(every[0], "doc_id", "n_words", "n_hit", "items") == rows(every[1], "doc_id", "n_words", "n_hit", "items")
    texts = [r.text for r in docs.collect()]
    want = brute_hits(texts, [("" if n is None else str(n), t or "") for n, t in items], 10)
    assert sorted((r.n_words, r.n_hit, r.items) for r in every[1].collect()) == sorted(want)
    left = {r.text for r in remove_passages(every[1]).collect()}
    assert "before  after, " + "more words " * 20 in left and "One two three." not in left
    assert find_passages(none, benchmark).count() == 0 and find_passages(edge, benchmark.where("false")).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        find_passages(docs, benchmark, most_words=5)


def test_large_benchmarks_stay_in_spark(spark, edge):
    import inspect

    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i % 25, make(r.choice([1, 2, 3, 5, 9, 10, 11, 30]) if i < 30 else 20)) for i in range(60)] + [(None, make(15)), (99, None)]
    full = [t for _, t in items if t]
    texts = [make(20) + " " + r.choice(full) + " " + make(20) if i % 3 else make(60) for i in range(60)]
    docs = documents(spark, texts).select("doc_id", "text", "lang").unionByName(edge.select("doc_id", "text", "lang"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    listed = [("" if n is None else str(n), t or "") for n, t in items]
    for window in (4, 10):
        want = brute_hits([x.text for x in docs.collect()], listed, window)
        # many parts, and slices of a few documents each
        got = find_passages(docs, benchmark, window, carry=("lang",), part_words=50, slice_bytes=2000)
        assert sorted((x.n_words, x.n_hit, x.items) for x in got.collect()) == sorted(want)
        one = find_passages(docs, benchmark, window, carry=("lang",))
        assert rows(got, "doc_id", "text", "lang", "spans", "items") == rows(one, "doc_id", "text", "lang", "spans", "items")
    assert inspect.signature(find_passages).parameters["most_words"].default is None


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    """One id in 400 rows with different texts, first or last, and a bound on the sample."""
    from gaugeframe.llm.quality import train

    rows = [(i, f"Plain sentence number {i} reads well. " * 5 if i % 2 else "CLICK!!! $$$ 0 0 0 " * 9) for i in range(200)]
    many = [(7, f"text {k} of one id " * (k % 9 + 1)) for k in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 200, 2)], "doc_id long, quality int, toxic int")
    models = [train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, most=60) for r, n in ((rows + many, 1), (many + rows, 5))]
    assert models[0] is not None and models[0].prior == models[1].prior and (models[0].weights == models[1].weights).all()


def test_equal_rows_are_encoded_once(spark):
    from gaugeframe.llm.common import row_key
    from gaugeframe.llm.token_counts import misses

    docs = spark.createDataFrame([(1, "one text")] * 3000 + [(2, "one text"), (3, None), (None, None)], "doc_id long, text string")
    keyed = docs.select(*row_key("doc_id", "text"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    wanted = keyed.groupBy("digest").agg(F.min(F.struct("k1", "k2")).alias("k"))
    assert sorted(r.text for r in misses(wanted, docs, "doc_id", "text").collect()) == ["", "one text"]


def test_a_set_is_sent_to_a_bucket_once(spark):
    """A bucket that a task can hold is compared block by block in it, not dealt out to pairs of blocks."""
    import gaugeframe.llm.chosen_path as c

    rows = spark.range(2213).selectExpr("7L AS bucket", "struct(id AS k1, id AS k2) AS k", "2213L AS m", "900000L AS volume")
    assert c._dealt(rows).count() == 2213
    for left in (0, 1300):
        met = np.zeros((2213, 2213), int)
        for one, other in c.block_pairs(np.full(2213, 400), left):
            assert max(len(one), len(other)) <= c.BLOCK
            met[np.ix_(one, other if len(other) else one)] += 1
        across = np.arange(2213) < left
        wanted = across[:, None] & ~across[None, :] if left else np.ones_like(met, bool)
        assert ((met | met.T) == (wanted | wanted.T)).all()


def test_links_of_buckets_cut_into_parts(spark, monkeypatch):
    import gaugeframe.llm.chosen_path as c

    for name, size in (("LEAF", 8), ("BLOCK", 3), ("HELD", 8)):
        monkeypatch.setattr(c, name, size)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(90)] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    assert [tuple(x) for x in near_duplicates(documents(spark, texts)).orderBy("doc_id").select("doc_id", "class_id", "n_links").collect()] == brute_links(texts)


def test_spent_tables_are_dropped(spark, tmp_path, monkeypatch):
    """What operators leave in the shared folder is what their result still reads."""
    import gaugeframe.llm.common as common

    monkeypatch.setattr(common, "shared_folder", lambda s, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{random.random()}")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for found in (remove_repeats(docs), near_duplicates(docs)):
        assert found.count() == docs.count()
    left = sorted(p.name.rpartition("-")[0].rpartition("-")[0] for p in tmp_path.iterdir())
    assert left == ["reach", "repeated-anchors", "set-classes", "sets"]


def test_workers_keep_little_of_what_other_operators_needed():
    import gaugeframe.llm.common as common
    import gaugeframe.llm.words as kept

    n = KEPT + 5
    assert int(powers(BASE, n)[-1]) == pow(BASE, n - 1, 1 << 64) and len(powers(BASE, 1000)) == 1000
    assert sum(len(x) for x in kept._POWERS.values()) <= 2 * KEPT
    batch = pa.record_batch({"text": ["x" * 3000] * 4000})
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine = encoder(path)
    assert sum(b.num_rows for b in blocks([batch], keep=path)) == 4000 and encoder(path) is mine
    # for blocks of 8 MB a worker kept 268 MB of powers
    assert max(b.nbytes for b in blocks([batch])) <= 1.1 * (1 << 20) and not common._ENCODERS
