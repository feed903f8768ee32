"""Running values over ordered rows, and joins whose hot keys are spread.

A key of any size is cut over several tasks: rows are ranged by key and order, each part runs over its own
rows, and what a part begins with is handed over from the parts before it, one row a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.sources.tables import written


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the row before in any column; nulls equal one another. The first row does not."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n < 2:
        return out
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        null = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(null, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)
    return out


def _since(values: np.ndarray, begins: np.ndarray, add, undo) -> np.ndarray:
    """Running values that begin again where ``begins`` is true."""
    run = add.accumulate(values)
    at = np.maximum.accumulate(np.where(begins, np.arange(len(values)), 0))
    before = np.where(at > 0, run[at - 1], 0)
    return undo(run, before)


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """``df`` with ``_place``, the number of a row within its key, from 1, and running values of long columns.

    A column of ``sums`` or ``xors`` is replaced by its sum or exclusive-or over the rows of the key up to and
    with this one. Rows are in the order of ``order``, nulls first; rows that tie there are
    in any order. A null key is a key. The result is a written table, so places never change.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_part", "_row", "_place")), T.StructField("_first", T.BooleanType())])
    names = df.columns
    running_of = {n: (np.add, np.subtract) for n in sums} | {n: (np.bitwise_xor, np.bitwise_xor) for n in xors}

    def scan(batches):
        part, seen, first = TaskContext.get().partitionId(), 0, True
        last, place, held = None, 0, dict.fromkeys(running_of, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cells = [b.column(k) for k in keys]
            begins = changes(cells)
            begins[0] = last is None or [c[0].as_py() for c in cells] != last
            goes_on = np.cumsum(begins) == 0  # rows of the key that the batch before ended with
            firsts = np.full(n, first) & (goes_on if last is not None else np.cumsum(begins) == 1)
            at = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            places = np.arange(n) - at + 1 + np.where(goes_on, place, 0)
            out = {}
            for name, (add, undo) in running_of.items():
                values = _since(b.column(name).to_numpy(zero_copy_only=False).astype(np.int64), begins, add, undo)
                out[name] = np.where(goes_on, add(values, held[name]), values)
                held[name] = out[name][-1]
            last, place, first = [c[n - 1].as_py() for c in cells], places[-1], bool(firsts[-1])
            columns = [pa.array(out[c]) if c in out else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n)), pa.array(places), pa.array(firsts)], schema.names)
            seen += n

    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    table = written(ranged.mapInArrow(scan, schema))
    kept = ["_row", "_place", *keys, *running_of]
    borders = table.groupBy("_part").agg(F.max(F.struct(*kept)).alias("last"), F.min(F.struct(*kept)).alias("first")).orderBy("_part").collect()  # one row a part
    carried, total = [], None
    for row in borders:
        first, last = ([r[k] for k in keys] for r in (row["first"], row["last"]))
        start = total[1] if total and total[0] == first else [0] * (1 + len(running_of))
        carried.append((row["_part"], *start))
        own = [row["last"]["_place"], *(row["last"][n] for n in running_of)]
        if first == last:
            own = [own[0] + start[0], *(x ^ y if n in xors else x + y for n, x, y in zip(running_of, own[1:], start[1:]))]
        total = (last, own)
    names_of = ["_before", *(f"_before_{n}" for n in running_of)]
    starts = df.sparkSession.createDataFrame(carried, "_part long, " + ", ".join(f"`{n}` long" for n in names_of))
    joined = table.join(F.broadcast(starts), "_part", "left")  # one row a part of the table
    more = lambda n: F.when(F.col("_first"), F.col(n)).otherwise(F.lit(0).cast("long"))
    now = {n: (F.col(n).bitwiseXOR(more(f"_before_{n}")) if n in xors else F.col(n) + more(f"_before_{n}")) for n in running_of}
    return joined.select(*[now[c].alias(c) if c in now else F.col(c) for c in names], (F.col("_place") + more("_before")).alias("_place"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` the rows of ``left`` with it.

    At most ``share`` keys can each hold more than one in ``share`` of the weight: they are broadcast, and
    their rows of ``left`` do not move. No key of the others is hot. ``right`` is read three times and should
    be a written table; ``how`` is inner or left.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > total / share)
    if hot.isEmpty():
        return left.join(right.drop(weight), on, how)
    near = left.join(F.broadcast(hot.drop(weight)), on)  # at most ``share`` rows
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return near.unionByName(rest.join(right.where(F.col(weight) <= total / share).drop(weight), on, how), allowMissingColumns=True)
