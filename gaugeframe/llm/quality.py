"""Text quality by positive-unlabelled learning.

A linear model over text measures minimises the non-negative unbiased risk: trusted positives stand for
one class, unlabelled documents for the mixture, and the share of positives in the mixture (the class
prior) is estimated from how scores of both are distributed. Labels serve for training only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks
from gaugeframe.llm.words import raw_bytes, words_of


def _classes() -> np.ndarray:
    """Byte classes counted per text, one row each."""
    code = np.arange(256)
    groups = [
        (code >= 65) & (code <= 90), (code >= 97) & (code <= 122), (code >= 48) & (code <= 57), code >= 128, code == 32, code == 10,
        np.isin(code, list(b".,;:'\"()-?")), code == ord("!"), code == ord("|"), np.isin(code, list(b"%&$#*@^~")), np.isin(code, list(b"<>{}[]=/\\_+`")), code < 32,
    ]
    return np.array(groups)


CLASSES = _classes()


def _per_text(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[begins[1:]] - total[begins[:-1]]


def measures(column: pa.Array) -> np.ndarray:
    """Measures of whole texts: shares of byte classes, word lengths, repetition of words and pairs."""
    raw, begins = raw_bytes(column)
    n = np.diff(begins).astype(float)
    w = words_of(column)
    hashes, counts = w.hashes(), np.diff(w.first)
    owner, some = np.repeat(np.arange(len(n)), counts), np.maximum(counts, 1)
    out = [np.log1p(n), np.log1p(counts)]
    out += [_per_text(CLASSES[k][raw], begins) / np.maximum(n, 1) for k in range(len(CLASSES))]
    size = w.end - w.start
    out += [_per_text(x, w.first) / some for x in (size, size == 1, size > 12)]
    out.append(np.sqrt(np.maximum(_per_text(size.astype(float) ** 2, w.first) / some - out[-3] ** 2, 0)))

    def distinct(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owners))
        k, o = keys[order], owners[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, bool)
        return np.bincount(o[new], minlength=len(n)) / np.maximum(np.bincount(owners, minlength=len(n)), 1)

    out.append(distinct(hashes, owner))
    same_text = owner[1:] == owner[:-1]
    out.append(np.bincount(owner[1:][same_text & (hashes[1:] == hashes[:-1])], minlength=len(n)) / some)
    pair = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[same_text]
    out.append(distinct(pair, owner[1:][same_text]))
    return np.nan_to_num(np.stack(out, 1))


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 8], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -500, 500)))


def _descend(design: np.ndarray, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = (np.zeros(design.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both that the scorer was not fitted to.

    Above any cut, unlabelled scores are at least the prior times as frequent as positive ones; the cut
    with the least ratio, after an allowance for chance, gives the estimate.
    """
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(10 * len(cuts)) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    k = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[k] / max(p[k], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800, ridge: float = 1e-4) -> Model:
    """Non-negative unbiased risk with the logistic loss.

    Where the estimated risk of the negatives falls below zero, the step undoes that instead of using it.
    """
    both = np.concatenate([positive, unlabelled])
    model = Model(np.median(both, 0), np.maximum(both.std(0), 1e-6), np.zeros(1), 0.5)
    p, u = model.design(positive), model.design(unlabelled)

    def plain(w):
        return (_sigmoid(p[::2] @ w) - 1) @ p[::2] / len(p[::2]) + _sigmoid(u[::2] @ w) @ u[::2] / len(u[::2]) + ridge * w

    first = _descend(p, plain, 200)
    prior = model.prior = estimate_prior(p[1::2] @ first if len(p) > 1 else p @ first, u[1::2] @ first if len(u) > 1 else u @ first)

    def gradient(w):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        push = _sigmoid(fu) @ u / len(u) - prior * _sigmoid(fp) @ p / len(p)
        if negative < 0:
            return -push
        return prior * ((_sigmoid(fp) - 1) @ p) / len(p) + push + ridge * w

    model.weights = _descend(p, gradient, steps)
    return model


def held_out(doc_id: str) -> Column:
    """Rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fits on at most ``most`` trusted positives and ``most`` unlabelled documents, the first by a hash of
    the id; None if there are no positives or no documents.

    An id is positive if it has labels and all of them are 1; ids and labels that are null are passed
    over. Of rows that share an id the text with the smallest hash counts, so the model does not depend on
    the order of rows. The labels of held-out ids are never read.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    good = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).alias("l")).where("l = 1").select("id", F.lit(1).alias("kind"))
    every = docs.select(F.col(doc_id).cast("long").alias("id"), F.lit(0).alias("kind")).where("id IS NOT NULL")
    chosen = [x.orderBy(F.xxhash64("id"), "id").limit(most) for x in (good, every)]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def measure(batches):
        for b in blocks(batches):
            x = measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind").cast(pa.int32()), b.column("h"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "kind", "h", "x"])

    # at most 2 * most ids, whatever the number of documents
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))
    measured = rows.join(wanted, "id").select("id", "kind", "text", "h").mapInArrow(measure, "id long, kind int, h long, x array<double>")
    sample = sorted(measured.groupBy("id", "kind").agg(F.min(F.struct("h", "x")).alias("m")).select("id", "kind", "m.x").collect(), key=lambda r: r["id"])
    sides = [np.array([r["x"] for r in sample if r["kind"] == k]) for k in (1, 0)]
    return fit(*sides) if len(sides[0]) and len(sides[1]) else None


def score_quality(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns in ``carry`` for every row.

    A null text scores like an empty one; without a model every score is 0.5. Rows with a null id are not
    held out; equal texts get equal scores; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("_text"), *(F.col(c).alias(f"_carry_{c}") for c in carry))
    names = ["doc_id", "held_out", *(f"_carry_{c}" for c in carry)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*names).schema)

    def run(batches):
        for b in blocks(batches):
            score = model.score(measures(b.column("_text"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(score, pa.float64())], [*names, "score"])

    scored = own.mapInArrow(run, f"{schema}, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(f"_carry_{c}").alias(c) for c in carry))
