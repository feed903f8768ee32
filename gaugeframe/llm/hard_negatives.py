"""Hard negatives by Kronecker-packed products.

The components of several candidates are biased to be positive and laid into separate fields of one wide
integer. One multiplication of that integer by an anchor's biased component multiplies all of them; after
the sum over the components each field holds one candidate's sum, since a field is wide enough for the
largest. Taking the biases out again gives exact scores. Wide integers of up to 53 bits are held in doubles,
where products of whole numbers are exact and run as matrix products; wider ones are Python integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import MEET, groups_of, meeting, written

#: whole numbers up to two to this power are exact in a double
EXACT_BITS = 53
WIDE_FIELDS = 8


class Packed:
    """Vectors (rows) packed for products with vectors whose components lie in ``low .. high``."""

    def __init__(self, vectors: np.ndarray, low: int, high: int):
        n, self.dim = vectors.shape
        self.n, self.low = n, int(low)
        self.bias = int(vectors.min(initial=0))
        top = (int(vectors.max(initial=0)) - self.bias) * (int(high) - self.low) * max(1, self.dim)
        self.width = max(1, top.bit_length())
        self.fields = EXACT_BITS // self.width
        wide = self.fields == 0
        self.kind = object if wide else np.float64
        self.fields = WIDE_FIELDS if wide else self.fields
        biased = vectors.astype(object if wide else np.int64) - self.bias
        self.sums = biased.sum(axis=1) if n else np.zeros(0, np.int64)
        words = -(-n // self.fields)
        filled = np.zeros((words * self.fields, self.dim), biased.dtype)
        filled[:n] = biased
        shift = np.array([1 << (self.width * i) for i in range(self.fields)], dtype=biased.dtype)
        self.words = (filled.reshape(words, self.fields, self.dim) * shift[None, :, None]).sum(axis=1).astype(self.kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner product of every anchor (rows) with every vector (columns)."""
        whole = object if self.kind is object else np.int64
        a = anchors.astype(whole) - self.low
        product = (a.astype(self.kind) @ self.words.T).astype(whole)
        mask, out = (1 << self.width) - 1, np.empty((len(a), len(self.words), self.fields), whole)
        for i in range(self.fields):
            out[:, :, i] = (product >> (self.width * i)) & mask
        biased = out.reshape(len(a), len(self.words) * self.fields)[:, : self.n]
        sums = a.sum(axis=1)
        # (a + low)(x + bias), with a and x the biased components
        return biased + self.bias * sums[:, None] + self.low * self.sums[None, :] + self.dim * self.low * self.bias


ROW = "block long, dim int, bits int, n long, low long, high long, ids binary, keys binary, labels binary, vectors binary"


def _blocks(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Rows in blocks of about ``size``, vectors of one length together and in the narrowest integers that hold them."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.pmod(F.xxhash64("id", "key"), F.lit(n)).alias("block"), F.size("v").alias("dim"), F.struct(*rows.columns).alias("r"))
    grouped = dealt.groupBy("block", "dim").agg(F.collect_list("r").alias("rows"))
    schema = ROW + (", floors binary" if extra else "")

    def build(batches):
        for b in batches:
            for i in range(b.num_rows):  # one block a batch: a block is megabytes
                cell, dim = b.column("rows")[i].values, b.column("dim")[i].as_py()
                ids, keys, labels = (cell.field(c).to_numpy() for c in ("id", "key", "label"))
                matrix = cell.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
                bits = next(w for w in (8, 16, 32, 64) if -(1 << (w - 1)) <= low and high < 1 << (w - 1))
                values = [b.column("block")[i].as_py(), dim, bits, len(ids), low, high, *(x.tobytes() for x in (ids, keys, labels, matrix.astype(f"<i{bits // 8}")))]
                if extra:
                    values.append(cell.field(extra).flatten().to_numpy(zero_copy_only=False).tobytes())
                kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * (len(values) - 6)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], [c.split()[0] for c in schema.split(", ")])

    return written(grouped.mapInArrow(build, schema), "vector-blocks")


def _meet(anchors: DataFrame, files: DataFrame, work, schema: str, k: int) -> DataFrame:
    """``work`` over every anchor block and every vector block of its dimension, each pair once.

    Groups of blocks of bounded size meet in a task. Of what ``work`` gives, whose last columns are id, key and
    score, the task passes on the ``k`` best for each value of the columns before them.
    """
    weight = F.col("n") * (F.col("dim") + 8)
    _, askers = groups_of(anchors, weight, MEET // 4)
    n_files, groups = groups_of(files, weight, MEET)
    groups = max(groups, min(n_files, -(-4 * files.sparkSession.sparkContext.defaultParallelism // askers)))
    names = [c.split()[0] for c in schema.split(", ")]

    def unpack(t, i):
        n, bits, dim = (t.column(c)[i].as_py() for c in ("n", "bits", "dim"))
        one = lambda c, kind: np.frombuffer(t.column(c)[i].as_buffer(), kind)
        return one("ids", "<i8"), one("keys", "<i8"), one("labels", "<i8"), one("vectors", f"<i{bits // 8}").reshape(n, dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((len(names), 0), np.int64)]
        if left.num_rows and right.num_rows:
            low, high = min(right.column("low").to_pylist()), max(right.column("high").to_pylist())
            opened = [unpack(left, i) for i in range(left.num_rows)]
            packed = [(Packed(vectors, low, high), *facts) for *facts, vectors in opened]
            for i in range(right.num_rows):
                a_ids, a_keys, a_labels, a_vectors = unpack(right, i)
                floors = np.frombuffer(right.column("floors")[i].as_buffer(), "<i8").reshape(len(a_ids), -1) if "floors" in right.schema.names else None
                for at in range(0, len(a_ids), 128):  # bounds the matrix of scores
                    part = slice(at, at + 128)
                    asked = a_ids[part], a_keys[part], a_labels[part], None if floors is None else floors[part]
                    parts = [work(p.scores(a_vectors[part]), *facts, *asked) for p, *facts in packed]
                    found.append(_cut(np.concatenate(parts, axis=1), k))
        return pa.table([pa.array(c) for c in np.concatenate(found, axis=1)], names)

    return meeting(files, anchors, groups, askers, "ids", "keys").applyInArrow(run, schema)


def _cut(rows: np.ndarray, k: int) -> np.ndarray:
    """Columns of ``rows`` (last id, key, score) that are among the k best of those that agree in what stands before."""
    rows = rows[:, np.lexsort((rows[-2], rows[-3], ~rows[-1], *rows[:-3]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:-3, 1:] != rows[:-3, :-1]).any(axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return rows[:, np.arange(len(new)) - first < k]


def _best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, then key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((keys[near], ids[near], -scores[near]))][:k]


def mine_negatives(
    vectors: DataFrame, every: int = 100, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = 4096, anchor_block: int = 1024,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)`` and a score is the inner product with the anchor. Anchors are the
    rows whose id is divisible by ``every``. Positives are an anchor's ``k_positives`` best rows of its label
    with another id; for each the ``k_negatives`` best rows of other labels follow whose score lies between
    ``low`` and ``high`` hundredths of the positive's. Higher scores come first, ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; rows that repeat id,
    label and vector count once. Rows that share an id but differ are rows of their own, each an anchor if the
    id is one; of such ties in score and id the order is that of a hash. Vectors meet those of their own
    length. No anchors, positives or negatives give no rows; other columns are ignored; scores beyond 64 bits are an error.
    """
    x = F.col(embedding)
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(good).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    rows = written(rows.distinct().withColumn("key", F.xxhash64("label", "v")), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    files, askers = _blocks(rows, block), _blocks(asked, anchor_block)

    def positives(scores, ids, keys, labels, a_ids, a_keys, a_labels, _):
        out = []
        for i in range(len(a_ids)):
            at = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
            at = at[_best(scores[i, at], ids[at], keys[at], k_positives)]
            out.append(np.stack([np.full(len(at), a_ids[i]), np.full(len(at), a_keys[i]), ids[at], keys[at], scores[i, at].astype(np.int64)]))
        return np.concatenate(out, axis=1).astype(np.int64)

    found = _meet(askers, files, positives, "anchor long, akey long, id long, key long, score long", k_positives)
    w = Window.partitionBy("anchor", "akey").orderBy(F.desc("score"), "id", "key")
    best = written(found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k_positives), "positives")

    # the anchors again, each with the scores of its positives; missing ones have no band
    lists = best.groupBy(F.col("anchor").alias("id"), F.col("akey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("p"))
    none = -(2**63)
    floors = F.transform(F.sequence(F.lit(0), F.lit(k_positives - 1)), lambda i: F.coalesce(F.get("p", i)["score"], F.lit(none)))
    again = _blocks(written(asked.join(lists, ["id", "key"]).withColumn("floors", floors).drop("p"), "anchors"), anchor_block, "floors")

    def negatives(scores, ids, keys, labels, a_ids, a_keys, a_labels, tops):
        out = []
        for i in range(len(a_ids)):
            others = np.flatnonzero(labels != a_labels[i])
            s = scores[i, others].astype(object if np.abs(scores[i]).max(initial=0) > 2**55 else np.int64)
            for n, top in enumerate(tops[i].tolist()):
                if top == none:
                    continue
                at = np.flatnonzero((low * top <= 100 * s) & (100 * s <= high * top))
                at = at[_best(s[at], ids[others[at]], keys[others[at]], k_negatives)]
                m = others[at]
                out.append(np.stack([np.full(len(m), a_ids[i]), np.full(len(m), a_keys[i]), np.full(len(m), n + 1), ids[m], keys[m], s[at].astype(np.int64)]))
        return np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((6, 0), np.int64)

    hard = _meet(again, files, negatives, "anchor long, akey long, n long, negative_id long, nkey long, negative_score long", k_negatives)
    w = Window.partitionBy("anchor", "akey", "n").orderBy(F.desc("negative_score"), "negative_id", "nkey")
    ranked = hard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_negatives)
    named = best.select("anchor", "akey", F.col("n").cast("long").alias("n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "akey", "n"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
