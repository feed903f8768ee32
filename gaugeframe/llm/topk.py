"""Exact top-k by inner product with vector-approximation files.

A file holds a block of vectors twice: as cell numbers of a per-dimension quantiser with each vector's
distance from the middle of its cells, and exactly. The cells bound every score from both sides; exact
vectors are read only where the upper bound reaches the k-th score known so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import MEET, groups_of, meeting, written

CELLS = 256
ROW = 8
#: components of one file
FILE = 1 << 20
PLAIN = "dim int, n long, weight long, bits int, ids binary, exact binary"
FILES = PLAIN + ", codes binary, low binary, step binary, off binary"


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, middle of the first cell and width of a cell by dimension, and each vector's distance from the middles.

    Cells are equally wide; components far from nearly all others lie outside and count as in the nearest one.
    """
    x = vectors.astype(float)
    n, dim = x.shape
    ordered = np.sort(x, axis=0)
    a, b, low, high = (ordered[i] if n else np.zeros(dim) for i in (n // 64, n - 1 - n // 64, 0, n - 1))
    wide = b > a
    low, high = np.where(wide, np.maximum(low, 2 * a - b), low), np.where(wide, np.minimum(high, 2 * b - a), high)
    step = (high - low) / (cells - 1)
    codes = np.clip(np.rint((x - low) / np.where(step > 0, step, 1)), 0, cells - 1).astype(np.uint8)
    # whole numbers beyond 53 bits are rounded as doubles
    off = np.linalg.norm(x - (low + step * codes), axis=1) + np.linalg.norm(x, axis=1) * 2.0**-51
    return codes, low, step, off


def _packed(ids: np.ndarray, vectors: np.ndarray, approximated: bool) -> pa.RecordBatch:
    n, dim = vectors.shape
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    bits = next(w for w in (8, 16, 32, 64) if -(1 << (w - 1)) <= low and high < 1 << (w - 1))
    values = [dim, n, n * (dim + ROW), bits, ids.astype("<i8").tobytes(), vectors.astype(f"<i{bits // 8}").tobytes()]
    if approximated:
        values += [x.tobytes() for x in approximate(vectors)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * (len(values) - 4)]
    names = [c.split()[0] for c in (FILES if approximated else PLAIN).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names)


def _filed(rows: DataFrame, block: int, approximated: bool, name: str) -> DataFrame:
    """Rows in blocks of at most ``block`` vectors of one length, as each task meets them."""

    def build(batches):
        waiting: dict[int, list] = {}

        def emit(dim):
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            size = max(1, min(block, FILE // max(dim, 1)))
            for at in range(0, len(ids), size):
                yield _packed(ids[at : at + size], vectors[at : at + size], approximated)

        for b in batches:
            lengths = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                step = max(1, min(block, FILE // max(dim, 1)))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    ids = some.column("id").to_numpy()
                    waiting.setdefault(dim, []).append((ids, some.column("v").flatten().to_numpy().reshape(len(ids), dim)))
                    held = sum(len(i) for i, _ in waiting[dim])
                    if held >= block or held * dim >= FILE:
                        yield from emit(dim)
            if sum(v.size + len(i) for parts in waiting.values() for i, v in parts) > 4 * FILE:  # many lengths
                for dim in list(waiting):
                    yield from emit(dim)
        for dim in list(waiting):
            yield from emit(dim)

    return written(rows.mapInArrow(build, FILES if approximated else PLAIN), name)


def _arrays(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    dim, n, bits = (table.column(c)[i].as_py() for c in ("dim", "n", "bits"))
    one = lambda c, t: np.frombuffer(table.column(c)[i].as_buffer(), t)
    return one("ids", "<i8"), one("exact", f"<i{bits // 8}").reshape(n, dim)


class Best:
    """The k best different ``(score, id)`` of each query so far."""

    def __init__(self, n: int, k: int, kind):
        self.k = k
        self.scores, self.ids, self.have = np.zeros((n, k), kind), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        #: no score below it can still be among the best
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        old = np.arange(self.k) < self.have[touched, None]
        rows = np.concatenate([rows, np.repeat(touched, self.have[touched])])
        scores, ids = np.concatenate([scores, self.scores[touched][old]]), np.concatenate([ids, self.ids[touched][old]])
        if scores.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda j: (rows[j], -scores[j], ids[j])), np.int64)
        else:
            order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        rows, scores, ids = rows[new], scores[new], ids[new]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        rows, place = rows[kept], place[kept]
        self.scores[rows, place], self.ids[rows, place] = scores[kept], ids[kept]
        self.have[touched] = np.bincount(np.searchsorted(touched, rows), minlength=len(touched))
        full = touched[self.have[touched] == self.k]
        self.least[full] = np.nextafter(self.scores[full, self.k - 1].astype(float), -np.inf)


def _scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Exact scores of the pairs ``(q, v)``."""
    exact = object if kind == object else float
    if len(q) * 8 > len(queries) * len(vectors):
        return (queries.astype(exact) @ vectors.astype(exact).T)[q, v].astype(kind)
    out = np.empty(len(q), kind)
    step = max(1, FILE // max(1, queries.shape[1]))
    for at in range(0, len(q), step):
        a, b = queries[q[at : at + step]].astype(exact), vectors[v[at : at + step]].astype(exact)
        out[at : at + step] = (a * b).sum(axis=1).astype(kind)
    return out


def search(query_ids: np.ndarray, queries: np.ndarray, files, k: int, query_block: int = 1024) -> Best:
    """The k best of all files for each query, its own id left out.

    ``files`` yields ``ids, exact vectors, codes, low, step, off`` of one file after the other.
    """
    files = list(files)
    dim = queries.shape[1]
    most = [max((float(np.abs(x.astype(float)).max(initial=0)) for x in xs), default=0.0) for xs in ([queries], [f[1] for f in files])]
    top = most[0] * most[1] * max(1, dim)
    #: doubles lose nothing where they are small enough
    best = Best(len(query_ids), k, np.int64 if top < 2**52 else object)
    kind = np.float32 if top < 1e30 and max(most) < 1e30 else np.float64
    eps = float(np.finfo(kind).eps)
    norms = np.linalg.norm(queries.astype(float), axis=1) * (1 + 4 * eps)
    asked = np.concatenate([queries, norms[:, None]], axis=1, dtype=kind, casting="unsafe")
    by_id = np.argsort(query_ids, kind="stable")
    sorted_ids = query_ids[by_id]
    for ids, exact, codes, low, step, off in files:
        middle = low + step * codes
        # the rounding of the product itself is bounded by the lengths of both vectors
        off = off + (np.linalg.norm(middle, axis=1) + off) * 4 * (dim + 8) * eps
        bounds = np.concatenate([middle, off[:, None]], axis=1, dtype=kind, casting="unsafe").T
        copies = int(np.unique(ids, return_counts=True)[1].max(initial=1))
        first, last = (np.searchsorted(sorted_ids, ids, side=s) for s in ("left", "right"))
        own_v = np.repeat(np.arange(len(ids)), last - first)
        own_q = by_id[np.concatenate([np.arange(a, b) for a, b in zip(first, last) if b > a])] if len(own_v) else own_v
        for at in range(0, len(query_ids), query_block):
            part = slice(at, at + query_block)
            upper = asked[part] @ bounds
            mine = (own_q >= at) & (own_q < at + query_block)
            upper[own_q[mine] - at, own_v[mine]] = -np.inf
            least = best.least[part].copy()
            open_ = np.flatnonzero(np.isneginf(least))
            within = k * copies  # so many vectors hold k different ids
            if len(open_) and upper.shape[1] > within:
                spread = 2 * (norms[part][open_, None].astype(kind) * off.astype(kind))
                sure = np.partition(upper[open_] - spread, -within, axis=1)[:, -within].astype(float)
                sure -= 8 * eps * (np.abs(sure) + spread.max(axis=1))
                least[open_] = sure
            least = np.nextafter(least.astype(kind), kind(-np.inf))
            hopeful = np.flatnonzero(upper.max(axis=1, initial=-np.inf) >= least)
            some = max(1, FILE // max(1, len(ids)))
            for near in (hopeful[i : i + some] for i in range(0, len(hopeful), some)):
                # of a query without k scores all are near, but not the query itself
                bound = upper[near]
                q, v = np.divmod(np.flatnonzero((bound >= least[near, None]) & (bound > -np.inf)), max(1, len(ids)))
                if len(q):
                    best.add(near[q] + at, _scores(queries[near + at], exact, q, v, best.scores.dtype), ids[v])
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors of each query, ties to the smaller id.

    Components become ``floor(scale * x)``, the score is their inner product. Vectors that are null or
    hold a null or non-finite component, and rows without an id, take no part on either side. A query
    meets vectors of its own length only. Rows that repeat both id and vector count once; of one vector
    under many ids the ``k + 1`` smallest ids can matter and are kept. Fewer than k partners give fewer
    rows, an empty table gives none; other columns are ignored; a score beyond 64 bits is an error.

    Files and queries are dealt into groups of bounded size, and each group of files meets each group of
    queries in one task, which passes on the k best of the whole group for each query. So what is moved
    grows with the rows times the other side's groups, not its blocks.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(embedding)
        good = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
        return df.where(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")).distinct()

    copies = Window.partitionBy("v").orderBy("id")
    files = _filed(whole(vectors).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), block, True, "approximation-files")
    asked = _filed(whole(queries), block, False, "queries")
    (n_files, groups), (_, askers) = (groups_of(t, F.col("weight"), MEET) for t in (files, asked))
    groups = max(groups, min(n_files, -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // askers)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})

        def opened():
            for i in range(left.num_rows):
                ids, exact = _arrays(left, i)
                one = lambda c, t: np.frombuffer(left.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                yield ids, exact, one("codes", np.uint8).reshape(exact.shape), *(one(c, "<f8") for c in ("low", "step", "off"))

        ids, matrix = (np.concatenate(x) for x in zip(*(_arrays(right, i) for i in range(right.num_rows))))
        best = search(ids, matrix, opened(), k, query_block)
        kept = np.arange(k) < best.have[:, None]
        columns = np.repeat(ids, best.have), best.ids[kept], best.scores[kept]
        return pa.table([pa.array(c.tolist() if c.dtype == object else c, pa.int64()) for c in columns], names)

    pairs = meeting(files, asked, groups, askers, "ids", "exact")
    best = pairs.applyInArrow(meet, "query_id long, vec_id long, score long").repartition("query_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
