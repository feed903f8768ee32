"""The pipeline's stages against brute force on planted cases, and the whole of it on the smallest tables."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from test_documents import brute_hits, brute_links, documents
from tokenizers import Tokenizer

import corpus_pipeline as P
from gaugeframe.llm.chosen_path import AGREE, sketches
from gaugeframe.llm.common import written
from gaugeframe.llm.suffix_dedup import merged


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def planted():
    """Clean texts, exact and near copies, a shared passage of over 400 bytes, a benchmark passage."""
    r = random.Random(3)
    texts = [prose(r, r.randint(30, 120)) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace(" ", "  ")]
    shared, item = prose(r, 90), prose(r, 25)
    texts += [prose(r, 40) + "\n" + shared + "\n" + prose(r, 40) for _ in range(3)]
    texts += [prose(r, 60) + " " + item[: item.index(" ", 80)] + " " + prose(r, 60), item, "", None]
    return texts, item


def keep_repeats(texts, size=400):
    raw = [t.encode() for t in texts]
    count = {}
    for t in raw:
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] = count.get(t[i : i + size], 0) + 1
    out = []
    for t in raw:
        runs = merged([(i, i + size) for i in range(len(t) - size + 1) if count[t[i : i + size]] > 1])
        out.append(bytes(c for i, c in enumerate(t) if not any(a <= i < b for a, b in runs)).decode())
    return out


def test_stages_on_planted_cases(spark, tmp_path):
    texts, item = planted()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = written(documents(spark, texts), "planted")
    classes = brute_links(texts)
    first = {c for _, c, _ in classes}
    got = written(P.one_of_each_group(spark, docs, str(tmp_path)), "stage")
    assert sorted(r.doc_id for r in got.collect()) == sorted(first) and len(first) < len(texts) - 2
    kept = {i: texts[i] or "" for i in sorted(first)}
    after = dict(zip(kept, keep_repeats(list(kept.values()))))
    got = written(P.without_repeats(spark, got, str(tmp_path)), "stage")
    assert {r.doc_id: r.text for r in got.collect()} == after
    assert sum(after[i] != kept[i] for i in after) == 3
    got = written(P.without_benchmark(spark, got, str(tmp_path)), "stage")
    hits = dict(zip(after, brute_hits(list(after.values()), [("1", item)], 10)))
    left = {r.doc_id: r for r in got.collect()}
    assert set(left) == {i for i, (n, h, _) in hits.items() if 2 * h <= n}
    for i, r in left.items():
        assert r.n_chars == len(r.text) and (r.text == after[i]) == (hits[i][1] == 0)
    assert sum(h > 0 for _, h, _ in hits.values()) == 2 and got.columns == P.COLUMNS
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = P.packed(spark, got, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in left.items()}


def test_whole_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = P.good_quality(spark, docs, sf)
    assert good.columns == P.COLUMNS and 0 < good.count() <= docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * docs.join(labels.where("quality = 1"), "doc_id").count()
    out = P.run(spark, sf)
    whole = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() > 0 and whole.where("n <> end or n > 2048").count() == 0


def test_sketches_pass_every_pair_at_the_threshold():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (6, 40, 200, 3000):
        for _ in range(200):
            tokens = np.unique(r.integers(0, 2**64, n + n // 9 * 2, dtype=np.uint64))
            some = r.permutation(tokens)
            a, b = np.sort(some[: len(some) - n // 9]), np.sort(some[n // 9 :])
            bits = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert 128 - int(np.bitwise_count(bits[0] ^ bits[1]).sum()) >= AGREE


def test_repeated_passages_of_few_bytes_are_cut(spark):
    r = random.Random(5)
    one = [f"{a}{b}" for a in "klmnopqrst" for b in "uvwxyz"]
    # three bytes a word: 51 words go, 50 stay, however far both are from 400 bytes
    short, under = r.sample(one, 51), r.sample(one, 50)
    passage, fewer = " ".join(short), " ".join(under)
    texts = [prose(r, 60) + " " + passage + " " + prose(r, 60), prose(r, 50) + "\n" + passage.upper().replace(" ", ", ") + "\n" + prose(r, 70)]
    texts += [prose(r, 60) + " " + fewer + " " + prose(r, 60) for _ in range(2)] + [prose(r, 80), passage + " é" + prose(r, 30), None]
    assert len(passage) < 160
    want = [t and t.replace(passage, "").replace(passage.upper().replace(" ", ", "), "") for t in texts]
    got = {x.doc_id: x.text for x in P.without_repeats(spark, written(documents(spark, texts), "short"), "").collect()}
    assert got == {i: t or "" for i, t in enumerate(want)} and sum(a != b for a, b in zip(texts, want)) == 3


def test_packed_sequences_hold_the_ids_of_the_documents(spark):
    import numpy as np

    r = random.Random(7)
    texts = [prose(r, r.choice([1, 40, 1500])) for _ in range(20)] + ["", None]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, pieces = {}, {}
    for x in sorted(P.packed(spark, documents(spark, texts), "").collect(), key=lambda x: (x.sequence_id, x.offset)):
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(sequences.setdefault(x.sequence_id, [])) == x.offset and len(ids) == x.length
        sequences[x.sequence_id] += ids
        pieces.setdefault(x.doc_id, {})[x.start] = ids
    assert max(map(len, sequences.values())) <= 2048
    for i, text in enumerate(texts):
        assert sum((v for _, v in sorted(pieces[i].items())), []) == t.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_query_takes_digests_from_packed_ids(spark, monkeypatch):
    import gaugeframe.llm.queries as q

    seen = []
    monkeypatch.setattr(q, "pack", lambda pieces: seen.append(pieces.columns) or P.pack(pieces))
    got = q.QUERIES["op7_packing"](spark, "/root/testdata/sf0.001")
    assert "ids" in seen[0] and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cut = P.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, cut.select(*columns).collect()))
