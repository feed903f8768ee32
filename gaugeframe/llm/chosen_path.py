"""Near duplicates by a chosen-path join of word n-gram sets.

Every set starts at the root of each run and follows a few of its tokens, picked by a hash of the path
so far and the token: sets with much in common pick common tokens and meet again below. Buckets of one
set end; small ones are compared by brute force, first by one-bit minwise sketches and then exactly; large
ones are split by further tokens, unless the parts would cost as much as the bucket, which is then
compared in blocks. Runs are repeated until the chance that a pair at the threshold meets nowhere falls
below ``1 - recall``. A pair that meets several times is counted in the first of its buckets only. Equal
sets are joined beforehand by a digest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import NO_ID, blocks, dropped, row_key, written
from gaugeframe.llm.words import mix, words_of

#: children that two sets at the threshold share on average, at every step of a path
SHARED = 4.0
#: larger buckets are split further, if that pays; up to here a set meets the sketches of its bucket in less
#: time than its tokens take to be shipped for a split
LEAF = 4096
#: sets of a bucket that are compared at once; fewer if together they have more tokens
BLOCK, BLOCK_TOKENS = 512, 500_000
#: sets of a bucket that one task holds and compares block by block, and their tokens
HELD, HELD_TOKENS = LEAF, 4_000_000
DEPTH = 6
#: equal bits, of 128, that the sketches of a pair need: at the threshold 115 are expected, 64 by chance;
#: fewer than this at the threshold have a probability of about 1e-9
AGREE = 90
GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    A path that picks ``SHARED`` common tokens on average dies out with the probability that solves
    ``q = exp(SHARED * (q - 1))``, however deep it goes.
    """
    q = 0.0
    for _ in range(200):
        q = math.exp(SHARED * (q - 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def token_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, ascending, and where each text's begin (and the end).

    A text of fewer words than ``size``, but not none, has one n-gram: all its words.
    """
    w = words_of(column)
    h, counts = w.hashes(), np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(h) - size + 1)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = mix(code * GOLD + h[k : k + n])
    inside = owner[:n] == owner[size - 1 :] if n else np.zeros(0, bool)
    code, owners = code[inside], owner[:n][inside]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        x = counts[i : i + 1].astype(np.uint64)
        for v in range(w.first[i], w.first[i + 1]):
            x = mix(x * GOLD + h[v : v + 1])
        code, owners = np.append(code, x), np.append(owners, i)
    order = np.lexsort((code, owners))
    code, owners = code[order], owners[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owners[1:] != owners[:-1])
    return code[new], np.searchsorted(owners[new], np.arange(len(counts) + 1))


def children(path: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens go on from their path, and where to: arrays over tokens, ``sizes`` of their sets."""
    x = mix(tokens ^ mix(path))
    picked = (x >> np.uint64(11)).astype(float) * 2.0**-53 < SHARED / (threshold * sizes)
    return picked, mix(x + path * GOLD)


def sketches(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-bit minwise sketches, two words each: a bit of the least token in each of 128 ranges."""
    owner, place = np.repeat(np.arange(len(at) - 1), np.diff(at)), (code >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(code), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    out = np.zeros((len(at) - 1, 2), np.uint64)
    bit = (mix(code[first]) & np.uint64(1)) << (place[first] % 64).astype(np.uint64)
    np.bitwise_or.at(out, (owner[first], place[first] // 64), bit)
    return out


def _sets(size: int, runs: int, threshold: float):
    """Digest, size, sketch and first buckets of each text's set."""

    def run(batches):
        for b in blocks(batches, 1 << 20):
            code, at = token_sets(b.column("text"), size)
            n = np.diff(at)
            a, c = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)]) for x in (code + np.uint64(1), code ^ GOLD))
            each, owner = np.repeat(n, n), np.repeat(np.arange(len(n)), n)
            found, whose = [], []
            for r in range(runs):
                root = mix(np.full(1, r + 1, np.uint64))
                picked, to = children(np.repeat(root, len(code)), code, each, threshold)
                found.append(to[picked])
                whose.append(owner[picked])
            found, whose = np.concatenate(found), np.concatenate(whose)
            order = np.argsort(whose, kind="stable")
            offsets = np.searchsorted(whose[order], np.arange(len(n) + 1))
            paths = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[order].view(np.int64)))
            digests = [pa.array((x[at[1:]] - x[at[:-1]]).view(np.int64)) for x in (a, c)]
            bits = [pa.array(x.copy().view(np.int64)) for x in sketches(code, at).T]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *digests, pa.array(n, pa.int64()), *bits, paths], ["k1", "k2", "s1", "s2", "n", "g1", "g2", "paths"])

    return run, "k1 long, k2 long, s1 long, s2 long, n long, g1 long, g2 long, paths array<long>"


def _promising(threshold: float):
    """Rows, sorted by bucket, that have a partner in it of fitting size and sketch."""
    share = round(threshold * 10**6)

    def keep(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, n = (rows.column(c).to_numpy() for c in ("bucket", "n"))
        g1, g2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("g1", "g2"))
        good = np.zeros(len(bucket), bool)
        for o in range(1, LEAF):
            i = np.flatnonzero(bucket[o:] == bucket[:-o])
            if not len(i):
                break
            equal = 128 - np.bitwise_count(g1[i] ^ g1[i + o]).astype(int) - np.bitwise_count(g2[i] ^ g2[i + o])
            fits = np.minimum(n[i], n[i + o]) * 10**6 >= np.maximum(n[i], n[i + o]) * share
            i = i[(equal >= AGREE) & fits]
            good[i] = good[i + o] = True
        return rows.filter(pa.array(good)).select(["bucket", "m", "k1", "k2"])

    def run(batches):
        yield from map(keep, _groups(batches))

    return run


def _groups(batches):
    """Batches of whole buckets from rows that are sorted by bucket."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column("bucket").to_numpy()
        cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
        if cut == 0 and held and held[0].column("bucket")[0].as_py() == bucket[0]:
            held.append(b)
            continue
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def _first_met(threshold: float):
    """Rows, sorted by bucket, with a promising partner that they meet in no earlier bucket.

    ``seen`` holds the sorted buckets of each row. A pair stays in the first of its buckets at least, which is
    where it is counted; sets that meet in many buckets are compared in few.
    """
    share, most = round(threshold * 10**6), 256

    def keep(bucket: int, rows: pa.RecordBatch) -> np.ndarray:
        m, n = rows.num_rows, rows.column("n").to_numpy()
        g = [rows.column(c).to_numpy().view(np.uint64) for c in ("g1", "g2")]
        lists = [x[: np.searchsorted(x, bucket)] for x in (x.values.to_numpy() for x in rows.column("seen"))]
        owner = np.repeat(np.arange(m), [len(x) for x in lists])
        number = np.unique(np.concatenate(lists), return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        width, good = 1024, np.zeros(m, bool)
        for first in range(0, m, most):
            i = slice(first, min(m, first + most))
            equal = 128 - sum(np.bitwise_count(x[i, None] ^ x[None, :]).astype(np.int16) for x in g)
            wanted = (equal >= AGREE) & (np.minimum(n[i, None], n[None, :]) * 10**6 >= np.maximum(n[i, None], n[None, :]) * share)
            wanted[np.arange(i.stop - first), np.arange(first, i.stop)] = False
            for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
                a, b = np.searchsorted(number, [low, low + width])
                grid = np.zeros((m, width), np.float32)
                grid[owner[a:b], number[a:b] - low] = 1
                wanted &= (grid[i] @ grid.T) == 0
            good[i] |= wanted.any(1)
        return good

    def run(batches):
        for rows in _groups(batches):
            bucket = rows.column("bucket").to_numpy()
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            good = [keep(int(bucket[a]), rows.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(bucket)])]
            yield rows.filter(pa.array(np.concatenate(good))).select(["bucket", "k1", "k2"])

    return run


def compare(tokens, counts, copies, seen, bucket: int, left: int, threshold: float):
    """Links within a bucket, or between the first ``left`` rows of it and the rest (0: within).

    ``seen`` holds the sorted buckets of each row: a pair that shares an earlier one is left to that one.
    Gives for each row with links: row, number of links with copies, and a root of its connected part. Products of token matrices over the tokens that occur twice or more count what all
    pairs share.
    """
    m = len(counts)

    def shared(lists) -> np.ndarray:
        flat, owner = np.concatenate(lists), np.repeat(np.arange(m), [len(x) for x in lists])
        _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[number] > 1
        number, owner = np.unique(number[keep], return_inverse=True)[1], owner[keep]
        out = np.zeros((m, m), np.float32)
        width = 4096
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for first in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            a, b = np.searchsorted(number, [first, first + width])
            grid = np.zeros((m, width), np.float32)
            grid[owner[a:b], number[a:b] - first] = 1
            out += grid @ grid.T
        return out

    both = shared(tokens).astype(np.float64)
    # whole numbers, so that a pair exactly at the threshold counts
    linked = both * 10**9 * (1 + threshold) >= np.round(threshold * 10**9) * (counts[:, None] + counts[None, :]) - 1e-3
    np.fill_diagonal(linked, False)
    if left:
        linked[:left, :left] = linked[left:, left:] = False
    if not linked.any():
        return
    linked &= shared([x[: np.searchsorted(x, bucket)] for x in seen]) == 0
    rows = np.flatnonzero(linked.any(1))
    root = np.arange(m)
    while True:
        least = np.where(linked, root[None, :], m).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    total = linked @ copies
    for i in rows:
        yield int(i), int(total[i]), int(root[i])


def block_pairs(counts: np.ndarray, left: int):
    """Blocks of rows to compare: each with none (within), and each two; of two parts, those across only."""
    cuts, held = [0], 0
    for i, n in enumerate(counts.tolist()):
        if i > cuts[-1] and (i == left or i - cuts[-1] >= BLOCK or held + n > BLOCK_TOKENS):
            cuts.append(i)
            held = 0
        held += n
    every = [np.arange(a, b) for a, b in zip(cuts, [*cuts[1:], len(counts)])]
    for a, one in enumerate(every):
        if not left:
            yield one, one[:0]
        for other in every[a + 1 :]:
            if not left or one[0] < left <= other[0]:
                yield one, other


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``: the smallest node that it is connected to.

    Neighbours are moved, in turn, to the smallest larger-side and smaller-side neighbour until only stars
    are left; every round is a few joins and minima, and is written.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        around = both(edges)
        least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "edges")
        dropped(least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), "edges")
        dropped(large, least)
        sums = [e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, new)]
        dropped(edges)
        edges = new
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 1 - 1e-8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, class_id, n_links, set_id, n_copies`` and its key ``k1, k2``.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word n-grams is at least
    ``threshold``; ``n_links`` counts the others a document is linked to, ``class_id`` is the smallest id
    of its connected part, ``set_id`` of the documents with its very set, ``n_copies`` their number.
    Texts of fewer words have their whole sequence as one n-gram. Null texts and texts without words have
    no set and no link: each is a class of its own. Rows that share an id are documents of their own; a
    null id is never a ``class_id`` unless all ids of the class are null. Other columns are ignored; an
    empty table gives no rows. ``docs`` is read twice and must give the same rows both times.
    """
    runs = runs_for(recall)
    scan, schema = _sets(size, runs, threshold)
    keyed = docs.select(*row_key(doc_id, text), F.col(text).alias("text"))
    sets = written(keyed.mapInArrow(scan, schema), "sets")
    # equal sets first: k is the smallest key that has the set
    one = sets.where("n > 0").groupBy("s1", "s2", "n", "g1", "g2").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"))
    distinct = written(one, "distinct-sets")

    level = distinct.select(F.explode("paths").alias("bucket"), "k")
    leaves, spent, tokens = [], [], None
    for depth in range(DEPTH):
        sizes = written(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket-sizes")
        level = written(level.join(sizes, "bucket"), "buckets")
        dropped(sizes)
        spent.append(level)
        small = level.where(F.col("m") <= LEAF).join(distinct.select("k", "n", "g1", "g2"), "k").select("bucket", "m", "k.k1", "k.k2", "n", "g1", "g2")
        near = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_promising(threshold), "bucket long, m long, k1 long, k2 long")
        near = written(near.select("bucket", "m", F.struct("k1", "k2").alias("k")), "promising")
        seen = near.groupBy("k").agg(F.array_sort(F.collect_set("bucket")).alias("seen"))
        told = near.join(seen, "k").join(distinct.select("k", "n", "g1", "g2"), "k").select("bucket", "k.k1", "k.k2", "n", "g1", "g2", "seen")
        met = told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_first_met(threshold), "bucket long, k1 long, k2 long")
        leaves.append(written(met.select("bucket", F.struct("k1", "k2").alias("k")), "leaves"))
        dropped(near)
        spent.append(leaves[-1])
        large = level.where(F.col("m") > LEAF)
        if tokens is None:
            active = leaves[0].select("k").unionByName(large.select("k")).distinct()
            tokens = _tokens(docs, active.join(distinct.select("k", "copies"), "k"), size, doc_id, text)
        if not large.head(1):
            break
        if depth + 1 == DEPTH:
            leaves.append(large.select("bucket", "k"))
            break
        below = written(large.groupBy("k").agg(F.collect_list("bucket").alias("buckets")).join(tokens, "k").mapInArrow(_descend(threshold), "k1 long, k2 long, parent long, bucket long"), "children")
        # pairs to compare if every child were a leaf, against the pairs of the bucket itself
        cost = below.groupBy("parent", "bucket").agg(F.count(F.lit(1)).alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("cost"))
        verdict = large.select(F.col("bucket").alias("parent"), "m").distinct().join(cost, "parent", "left")
        stay = written(verdict.where(F.coalesce("cost", F.lit(0)) >= F.col("m") * F.col("m")).select("parent"), "dense-buckets")
        spent += [below, stay]
        leaves.append(large.select("bucket", "k").join(stay.select(F.col("parent").alias("bucket")), "bucket", "left_semi"))
        level = below.join(stay, "parent", "left_anti").select("bucket", F.struct("k1", "k2").alias("k"))
    found = _compared(leaves, tokens, threshold)
    dropped(*spent, tokens)

    links = found.groupBy("k1", "k2").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b")))
    named = distinct.select("s1", "s2", "n", "k", "copies", F.col("k.k1"), F.col("k.k2")).join(links, ["k1", "k2"], "left")
    named = named.join(roots.select(F.col("node.k1"), F.col("node.k2"), "root"), ["k1", "k2"], "left")
    table = written(named.select("s1", "s2", "n", "k", "copies", F.coalesce("n_links", F.lit(0)).alias("others"), F.coalesce("root", "k").alias("root")), "set-classes")
    dropped(distinct, found, roots)
    ident = lambda c: F.when(F.col(f"{c}.k1") != NO_ID, F.col(f"{c}.k1"))
    with_set = sets.where("n > 0").select("k1", "k2", "s1", "s2", "n").join(table, ["s1", "s2", "n"])
    with_set = with_set.select("k1", "k2", ident("root").alias("class_id"), (F.col("others") + F.col("copies") - 1).alias("n_links"), ident("k").alias("set_id"), F.col("copies").alias("n_copies"), F.col("root"))
    own = F.struct("k1", "k2")
    without = sets.where("n = 0").select("k1", "k2", F.when(F.col("k1") != NO_ID, F.col("k1")).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.when(F.col("k1") != NO_ID, F.col("k1")).alias("set_id"), F.lit(1).cast("long").alias("n_copies"), own.alias("root"))
    return with_set.unionByName(without).select(F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"), "class_id", "n_links", "set_id", "n_copies", "k1", "k2", "root")


def _tokens(docs: DataFrame, active: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """``k, copies, tokens`` of the sets that are split further or compared: no other is looked at again."""

    def scan(batches):
        for b in blocks(batches, 1 << 20):
            code, at = token_sets(b.column("text"), size)
            values = pa.array([code[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("copies"), values], ["k1", "k2", "copies", "tokens"])

    texts = docs.select(*row_key(doc_id, text), F.col(text).alias("text"))
    # equal rows share a key; one of them is read
    found = texts.join(active.select("k.k1", "k.k2", "copies"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    found = found.mapInArrow(scan, "k1 long, k2 long, copies long, tokens binary")
    return written(found.select(F.struct("k1", "k2").alias("k"), "copies", "tokens"), "tokens")


def _descend(threshold: float):
    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            keys = [b.column("k").field(i).to_pylist() for i in (0, 1)]
            for i, buckets in enumerate(b.column("buckets").to_pylist()):
                code = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint64)
                for p in buckets:
                    path = np.full(len(code), p, np.int64).view(np.uint64)
                    picked, to = children(path, code, np.full(len(code), len(code)), threshold)
                    to = to[picked].view(np.int64).tolist()
                    for column, x in zip(out, (keys[0][i], keys[1][i], p)):
                        column += [x] * len(to)
                    out[3] += to
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["k1", "k2", "parent", "bucket"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """``bucket, k, p, lo, hi`` of ``rows (bucket, k, m, volume)``: one row a set unless its bucket is cut into parts."""
    parts = F.ceil(F.greatest(F.col("m") / HELD, F.col("volume") / HELD_TOKENS)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("k", "bucket"), F.col("parts")).cast("int"))
    # a part meets itself and every other: (p, p), (p, later) and (earlier, p)
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, "p").alias("lo"), F.greatest(q, "p").alias("hi")))
    return dealt.withColumn("meet", F.explode(meets)).select("bucket", "k", "p", "meet.lo", "meet.hi")


def _compared(leaves: list[DataFrame], tokens: DataFrame, threshold: float) -> DataFrame:
    """Rows of every leaf bucket that have links: their number, and an edge to a root.

    Buckets with the same members are one. A task compares a bucket block by block, so a set is sent to a
    bucket once. Only a bucket of more than ``HELD`` sets, or of more tokens than a task holds, is dealt into
    parts by a hash of the key, and every two parts meet under a key of their own.
    """
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    every = written(every.select("bucket", "k"), "leaves")
    members = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("k", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    first = written(members.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).where("m > 1").select("bucket", "m"), "first-buckets")
    rows = written(every.join(first, "bucket"), "leaf-rows")
    seen = rows.groupBy("k").agg(F.array_sort(F.collect_set("bucket")).alias("seen"))
    volume = rows.join(tokens.select("k", (F.octet_length("tokens") / 8).alias("n")), "k").groupBy("bucket").agg(F.sum("n").alias("volume"))
    volume = written(volume, "bucket-volumes")
    dealt = _dealt(rows.join(volume, "bucket"))

    def scan(key, group):
        bucket, lo, hi = (x.as_py() for x in key)
        group = group.sort_by([("p", "ascending")]).combine_chunks()
        n = group.num_rows
        out = [[], [], [], [], []]
        left = int(np.count_nonzero(group.column("p").to_numpy() == lo)) if lo != hi else 0
        if n > 1 and (lo == hi or 0 < left < n):
            column = {c: group.column(c).chunk(0) for c in group.column_names}
            lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in column["tokens"]]
            seen = [x.values.to_numpy() for x in column["seen"]]
            counts = np.array([len(x) for x in lists])
            copies = column["copies"].to_numpy()
            keys = [column[c].to_numpy() for c in ("k1", "k2")]
            for one, other in block_pairs(counts, left):
                rows = np.concatenate([one, other])
                for i, total, root in compare([lists[r] for r in rows], counts[rows], copies[rows], [seen[r] for r in rows], bucket, len(one) if len(other) else 0, threshold):
                    for c, x in zip(out, (keys[0][rows[i]], keys[1][rows[i]], total, keys[0][rows[root]], keys[1][rows[root]])):
                        c.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["k1", "k2", "n_links", "r1", "r2"])

    met = dealt.join(seen, "k").join(tokens, "k").select("bucket", "lo", "hi", "p", F.col("k.k1"), F.col("k.k2"), "seen", "tokens", "copies")
    found = written(met.groupBy("bucket", "lo", "hi").applyInArrow(scan, "k1 long, k2 long, n_links long, r1 long, r2 long"), "links")
    dropped(every, first, rows, volume)
    return found
