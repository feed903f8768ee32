"""Packing pieces of documents into sequences: cutting stock by column generation.

Piece lengths are rounded up to units and counted. A linear program over patterns (how many pieces of
each length a sequence takes) minimises the number of sequences; its columns are priced by a knapsack
dynamic program. Patterns are rounded down, what is left is filled greedily, and the k-th piece of a
length takes the k-th slot of that length. Short pieces would lose too much by rounding: they are packed
into bundles first, in the same way but by their exact lengths, and a bundle is packed like a piece. The
histograms and plans have at most ``capacity / unit`` and ``capacity / 32`` lengths, whatever the number of
documents.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, encoder, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, narrow: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if
    wanted, ``ids`` (little-endian unsigned 32-bit integers; with ``narrow`` 16-bit ones, which take half the
    space while rows are moved and which ``widen_ids`` turns back; ids of more than 16 bits are an error then).

    A null or empty text gives one piece with the end id alone. Rows with a null or repeated id are cut
    one by one; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in blocks(batches, keep=tokenizer):
            owner, start, length, crc, total, body = [], [], [], [], [], []
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            for i, (d, raw) in enumerate(zip(b.column("doc_id").to_pylist(), encode(texts))):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    piece = raw[at * 4 : (at + capacity) * 4]
                    owner.append(d)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if keep_ids:
                        body.append(_narrow(piece) if narrow else piece)
            columns = [pa.array(x, pa.int64()) for x in (owner, start, length, crc, total)] + ([pa.array(body, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def _narrow(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if wide.max(initial=0) >= 1 << 16:
        raise ValueError("an id does not fit into 16 bits")
    return wide.astype("<u2").tobytes()


def widen_ids(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids`` of 16 bits as ids of 32 bits; other columns and the order of rows stay."""
    schema = pieces.schema

    def run(batches):
        for b in blocks(batches, 4 << 20):
            ids = [x if x is None else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in b.column("ids").to_pylist()]
            yield b.set_column(b.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    return pieces.mapInArrow(run, schema)


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits: unbounded knapsack over sizes."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r], took[r] = best[r - 1], -1
        fits = np.searchsorted(sizes, r, side="right")
        if fits:
            gain = best[r - sizes[:fits]] + values[:fits]
            k = int(np.argmax(gain))
            if gain[k] > best[r] + 1e-12:
                best[r], took[r] = gain[k], k
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= int(sizes[took[r]])
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often the linear program uses each.

    Ends when the number of sequences is within ``gap`` of a lower bound: the volume, or the current
    number over the value of the best pattern. ``most`` bounds the simplex steps; the solution is feasible
    after any number of them, so a run that stops early packs less tightly and loses nothing.
    """
    volume, bound = float(sizes @ demand) / room, 0.0
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ demand
    for step in range(most):
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            amount = inverse @ demand
        value, pattern = price(np.maximum(inverse.sum(0), 0), sizes, room)
        bound = max(bound, volume, amount.sum() / max(value, 1.0))
        if amount.sum() <= bound * (1 + gap):
            break
        way = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, np.maximum(amount, 0) / way, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount -= ratio[out] * way
        amount[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return basis.astype(np.int64).reshape(m, m), np.maximum(amount, 0)


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """``(pattern, times)`` that together hold every piece of the histogram exactly once."""
    if not len(sizes):
        return []
    basis, amount = column_generation(sizes, demand.astype(float), room)
    times, left = np.floor(amount + 1e-6).astype(np.int64), demand.astype(np.int64)
    found = []
    for k in np.argsort(-times, kind="stable"):
        a = basis[:, k]
        used = a > 0
        n = int(min(times[k], (left[used] // a[used]).min())) if used.any() else 0
        if n:
            found.append((a.copy(), n))
            left = left - n * a
    while left.any():
        a, free = np.zeros(len(sizes), np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            a[i] = min(left[i], free // sizes[i])
            free -= int(a[i] * sizes[i])
        n = int((left[a > 0] // a[a > 0]).min())
        found.append((a, n))
        left = left - n * a
    return found


def slots(sizes: np.ndarray, found: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: rank of the first slot, first sequence and slots a sequence, pattern by pattern."""
    first, table = 0, {int(s): ([], [], []) for s in sizes}
    reached = dict.fromkeys(table, 0)
    for pattern, n in found:
        for i in np.flatnonzero(pattern):
            s, k = int(sizes[i]), int(pattern[i])
            for column, x in zip(table[s], (reached[s], first, k)):
                column.append(x)
            reached[s] += n * k
        first += n
    return {s: tuple(np.array(c, np.int64) for c in columns) for s, columns in table.items()}


class Places:
    """Sequences of the pieces of a histogram of exact lengths.

    Pieces of up to ``capacity / 32`` ids are short: they go to bundles of a quarter of the capacity, and the
    b-th bundle is the piece of that size which follows the b-th of the others.
    """

    def __init__(self, capacity: int, unit: int):
        self.capacity, self.unit = capacity, unit
        self.bundle = capacity // 4 // unit
        self.short = capacity // 32 if self.bundle else 0

    def size_of(self, length: np.ndarray) -> np.ndarray:
        """Sizes by which pieces are counted: minus the length of short ones, units of others."""
        return np.where(length <= self.short, -length, -(-length // self.unit))

    def fit(self, histogram: list[tuple[int, int]]) -> Places:
        counts = dict(histogram)
        short = sorted((-s, n) for s, n in counts.items() if s < 0)
        long = {s: n for s, n in counts.items() if s > 0}
        self.inside, self.first_bundle = {}, long.get(self.bundle, 0)
        if short:
            sizes, demand = (np.array(x, np.int64) for x in zip(*short))
            found = plan(sizes, demand, self.bundle * self.unit)
            self.inside = slots(sizes, found)
            long[self.bundle] = self.first_bundle + sum(n for _, n in found)
        sizes, demand = (np.array(x, np.int64) for x in zip(*sorted(long.items()))) if long else (np.zeros(0, np.int64),) * 2
        self.table = slots(sizes, plan(sizes, demand, self.capacity // self.unit))
        return self

    @staticmethod
    def _slot(table: dict[int, tuple[np.ndarray, ...]], size: int, rank: np.ndarray) -> np.ndarray:
        start, first, times = table[size]
        k = np.searchsorted(start, rank, side="right") - 1
        return first[k] + (rank - start[k]) // times[k]

    def sequence(self, size: int, rank: np.ndarray) -> np.ndarray:
        """Sequences of the pieces of one size with the given ranks."""
        if size < 0:
            size, rank = self.bundle, self.first_bundle + self._slot(self.inside, -size, rank)
        return self._slot(self.table, size, rank)


def pack(pieces: DataFrame, length: str = "length", capacity: int = 2048, unit: int = 16) -> DataFrame:
    """``pieces`` with ``sequence_id`` (gapless from 0) and ``offset`` (place of its first id there).

    Every row must have a length from 1 to ``capacity``; equal rows are packed one by one and all other
    columns are kept, except that ``sequence_id`` and ``offset`` are replaced. No rows give no rows.
    ``unit`` is the rounding of lengths in the plan: ids of a sequence may stay unused by at most
    ``unit - 1`` a piece beyond what the plan wastes; pieces of up to ``capacity / 32`` ids are not rounded but
    share bundles. Ranks are taken per task and then shifted, so that no task sees all pieces of a length.
    """
    # written first: ranks and sequences are found from lengths alone, and rows are moved once, at the end
    named = written(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "cut-pieces")
    narrow = "_row long, _length long, _part long, _size long, _rank long"
    places = Places(capacity, unit)

    def rank(batches):
        # sizes from -short to capacity / unit
        part, seen = TaskContext.get().partitionId(), np.zeros(places.short - (-capacity // unit) + 1, np.int64)
        for b in batches:
            n = b.column("_length").to_numpy(zero_copy_only=False)
            size = places.size_of(n)
            order = np.argsort(size, kind="stable")
            ordered = size[order] + places.short
            begin = np.searchsorted(ordered, ordered, side="left")
            ranks = np.empty(len(n), np.int64)
            ranks[order] = np.arange(len(n)) - begin + seen[ordered]
            seen += np.bincount(ordered, minlength=len(seen))
            columns = [pa.array(np.full(len(n), part)), pa.array(size), pa.array(ranks)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["_row", "_length", "_part", "_size", "_rank"])

    ranked = written(named.select("_row", F.col(length).cast("long").alias("_length")).mapInArrow(rank, narrow), "pieces")
    counts = ranked.groupBy("_part", "_size").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity / unit + capacity / 32 rows
    places.fit([(r["_size"], r["n"]) for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()])
    before = counts.select("_part", "_size", (F.sum("_n").over(Window.partitionBy("_size").orderBy("_part")) - F.col("_n")).alias("_before"))

    def assign(batches):
        for b in batches:
            size = b.column("_size").to_numpy(zero_copy_only=False)
            r = b.column("_rank").to_numpy(zero_copy_only=False) + b.column("_before").to_numpy(zero_copy_only=False)
            sequence = np.empty(len(r), np.int64)
            for s in np.unique(size):
                at = size == s
                sequence[at] = places.sequence(int(s), r[at])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_length"), pa.array(size), pa.array(r), pa.array(sequence)], ["_row", "_length", "_size", "_rank", "sequence_id"])

    placed = ranked.join(before, ["_part", "_size"]).mapInArrow(assign, "_row long, _length long, _size long, _rank long, sequence_id long")
    w = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank")
    placed = placed.select("_row", "sequence_id", (F.sum("_length").over(w) - F.col("_length")).alias("offset"))
    return named.join(placed, "_row").drop("_row")
