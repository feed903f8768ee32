"""Groups of ordered rows that depend on the group before them, for keys of any size.

Rows are ranged by key and order and each part is folded by itself, so a large key is spread over many
tasks. What a key's part begins with is the open group of the part before it. It is first taken to be
none; parts whose beginning turns out otherwise are folded again from what was handed over, until nothing
changes. As soon as a group closes at the same row either way the rest of a part is the same, so usually
two or three rounds are enough; a single group over many parts takes a round for each.

Keys that lie whole within a batch need none of this: a fold that has ``whole`` takes them all at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugeframe.sources.tables import written

GROUP, ROW, STATE = 0, 1, 2


def _schema(rows: DataFrame, keys: list[str], values: list[str], out: T.StructType) -> T.StructType:
    own = [T.StructField(f"_v{i}", rows.schema[c].dataType) for i, c in enumerate(values)]
    rest = [("_kind", T.IntegerType()), ("_part", T.LongType()), ("_row", T.LongType()), ("_seq", T.LongType()), ("_first", T.BooleanType()), ("_last", T.BooleanType()), ("_state", T.BinaryType())]
    return T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *own, *(T.StructField(f"_o_{f.name}", f.dataType) for f in out), *(T.StructField(n, t) for n, t in rest)])


class _Part:
    """Folds the rows of one part and keeps what the next part needs."""

    def __init__(self, part: int, start: bytes | None, widths: tuple[int, int, int]):
        self.part, self.widths = part, widths
        self.fold = pickle.loads(start) if start else None
        self.key = self.first = None
        self.row, self.seq, self.n_first, self.out = 0, 0, 0, []

    def _put(self, kind: int, values=None, group=None, last=False, state=None) -> None:
        k, v, o = self.widths
        key = (None,) * k if kind == STATE else self.key
        self.out.append((*key, *(values or (None,) * v), *(group or (None,) * o), kind, self.part, self.row, self.seq, self.key == self.first, last, state))

    def _close(self, last: bool = False) -> None:
        group = self.fold.close() if self.fold is not None else None
        if group is not None:
            self._put(GROUP, group=group, last=last)

    def leave(self) -> None:
        """The key has no further rows."""
        self._close()
        if self.key == self.first:
            self.n_first = self.seq + 1
        self.fold = None

    def add(self, key: tuple, values: tuple, facts: tuple | None, make: Callable) -> None:
        if self.key is None:
            self.key = self.first = key
        elif key != self.key:
            self.leave()
            self.key, self.seq = key, 0
        self.row += 1
        if facts is not None:
            self.fold = make(*facts)
        elif self.fold is None:  # the key began in an earlier part
            self._put(ROW, values=values)
        else:
            group = self.fold.add(*values)
            if group is not None:
                self._put(GROUP, group=group)
                self.seq += 1

    def end(self) -> None:
        if self.key is None:
            return
        if self.key == self.first:
            self.n_first = self.seq
        n_last = self.seq
        state = pickle.dumps(self.fold) if self.fold is not None else None
        self._close(last=True)
        self._put(STATE, state=pickle.dumps((self.first, self.key, state, self.n_first, n_last)))


def fold_groups(rows: DataFrame, facts: DataFrame, keys: list[str], order: list[str], make: Callable, out: str, number: str = "group") -> DataFrame:
    """Groups of each key in order: the keys, ``number`` (from 0) and the columns of the DDL ``out``.

    ``facts`` has one row for each key and its columns are the arguments of ``make``. What that gives has
    ``add(*row)``, with the columns of ``rows`` other than the keys, which returns the group that the row
    closes or None; ``close()``, which returns the open group or None; ``facts``, the arguments; and can be
    pickled. Rows that tie in ``order`` come in any order. A null key is a key; a key without facts is an error.
    ``make`` may have ``whole(first, size, values, facts)``, which folds many keys: from the first row and the
    number of rows of each, the columns of their rows and their facts it gives the key of every group, its
    place there and the columns of ``out``.
    """
    spark, struct = rows.sparkSession, T.StructType.fromDDL(out)
    values, own = ([c for c in d.columns if c not in keys] for d in (rows, facts))
    named = rows.select(*keys, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values)), F.lit(1).alias("_mark"))
    marks = facts.select(*keys, *(F.col(c).alias(f"_f{i}") for i, c in enumerate(own)), F.lit(0).alias("_mark"))
    schema = _schema(rows, keys, values, struct)
    kinds = [to_arrow_type(f.dataType) for f in schema]
    widths = (len(keys), len(values), len(struct))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], schema.names)

    def whole(b: pa.RecordBatch, part: int, at: np.ndarray) -> pa.RecordBatch | None:
        """Groups of the keys whose facts are rows ``at``; the last of these only ends the one before it."""
        size = np.diff(at) - 1
        at, size = at[:-1][size > 0], size[size > 0]
        if not len(at):
            return None
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        rows = pa.array(np.repeat(at + 1 - first, size) + np.arange(size.sum()))
        at = pa.array(at)
        of, seq, columns = make.whole(first, size, [b.column(f"_v{i}").take(rows) for i in range(widths[1])], [b.column(f"_f{i}").take(at) for i in range(len(own))])
        n, owner = len(of), at.take(pa.array(of))
        same = lambda x: pa.array(np.full(n, x))
        rest = [same(GROUP), same(part), same(0), pa.array(seq), same(False), same(False), pa.nulls(n, pa.binary())]
        found = [*(b.column(k).take(owner) for k in keys), *(pa.nulls(n, t) for t in kinds[widths[0] : widths[0] + widths[1]]), *columns, *rest]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(found, kinds)], schema.names)

    def pieces(b: pa.RecordBatch, begun: bool):
        """A batch cut before and behind the keys that lie whole in it; of those, the rows of their facts."""
        at = np.flatnonzero(b.column("_mark").to_numpy() == 0)
        at = at if begun else at[at > 0]  # the first key of a part may go on from the part before
        if len(at) < 2:
            return [(b, None)]
        return [(b.slice(0, int(at[0])), None), (b, at), (b.slice(int(at[-1])), None)]

    def scan(starts: dict[int, bytes] | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]):
            now: _Part | None = None
            many = starts is None and hasattr(make, "whole")
            for b, at in (x for b in batches for x in (pieces(b, now is not None) if many else [(b, None)])):
                if at is not None:
                    now.leave()
                    now.row += int(at[-1] - at[0])
                    groups = whole(b, now.part, at)
                    if groups is not None:
                        yield groups
                    continue
                cells = [b.column(c).to_pylist() for c in (*keys, *(f"_v{i}" for i in range(widths[1])))]
                if starts is None:
                    marked = b.column("_mark").to_pylist()
                    told = list(zip(*(b.column(f"_f{i}").to_pylist() for i in range(len(own))))) if own else [()] * b.num_rows
                    parts = [TaskContext.get().partitionId()] * b.num_rows
                else:
                    marked, told, parts = [1] * b.num_rows, [], b.column("_part").to_pylist()
                done: list[tuple] = []
                for i, row in enumerate(zip(*cells)):
                    if now is None or now.part != parts[i]:
                        if now is not None:
                            now.end()
                            done += now.out
                        now = _Part(parts[i], starts and starts[parts[i]], widths)
                    now.add(row[: widths[0]], row[widths[0] :], told[i] if not marked[i] else None, make)
                if now is not None:
                    done += now.out
                    now.out = []
                if done:
                    yield batch(done)
            if now is not None:
                now.end()
                if now.out:
                    yield batch(now.out)

        return run

    by = [*keys, "_mark", *(f"_v{values.index(c)}" for c in order)]
    every = named.unionByName(marks, allowMissingColumns=True)
    base = written(every.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(scan(None), schema))
    info = {r["_part"]: pickle.loads(r["_state"]) for r in base.where(F.col("_kind") == STATE).select("_part", "_state").collect()}  # one row a part
    parts = sorted(info)
    before = {p: q for q, p in zip(parts, parts[1:]) if info[p][0] == info[q][1]}  # parts that begin within a key
    tables, last_run, used = [base], {}, {}
    while True:
        todo = {}
        for p, q in before.items():
            at, start = q, info[q][2]
            while start is None:  # nothing is known yet: the key's facts, and no open group
                at = before[at]
                start = info[at][2] and pickle.dumps(make(*pickle.loads(info[at][2]).facts))
            if used.get(p) != start:
                todo[p] = start
        if not todo:
            break
        again = base.where((F.col("_kind") == ROW) & F.col("_part").isin(list(todo))).repartition("_part").sortWithinPartitions("_part", "_row")
        tables.append(written(again.mapInArrow(scan(todo), schema)))
        used |= todo
        for r in tables[-1].where(F.col("_kind") == STATE).select("_part", "_state").collect():
            p, (_, _, state, n, _) = r["_part"], pickle.loads(r["_state"])
            first, key, old, _, n_last = info[p]
            info[p] = (first, key, state if first == key else old, n, n if first == key else n_last)
            last_run[p] = len(tables) - 1
    number_before: dict[int, int] = {}
    for p, q in before.items():
        number_before[p] = info[q][4] + (number_before.get(q, 0) if info[q][0] == info[q][1] else 0)
    # the group that a part ends with belongs to the next part if its key goes on there
    goes_on = sorted(before.values())
    ends = lambda t, some: t.where((F.col("_kind") == GROUP) & ~(F.col("_last") & F.col("_part").isin(some)))
    groups = ends(base, goes_on) if before else base.where(F.col("_kind") == GROUP)
    for i, t in enumerate(tables[1:], 1):
        mine = [p for p, r in last_run.items() if r == i]
        if mine:  # folded again were rows of the first key only, which is the last one if it fills the part
            groups = groups.unionByName(ends(t.where(F.col("_part").isin(mine)), [q for q in goes_on if info[q][0] == info[q][1]]))
    at = F.col("_seq")
    if before:
        shift = spark.createDataFrame(sorted(number_before.items()), "_part long, _shift long")
        groups = groups.join(F.broadcast(shift), "_part", "left")  # at most one row a part
        at = at + F.when(F.col("_first"), F.coalesce("_shift", F.lit(0))).otherwise(0)
    return groups.select(*keys, at.cast("long").alias(number), *(F.col(f"_o_{f.name}").alias(f.name) for f in struct))
