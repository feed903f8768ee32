"""Assignments of least total cost, many at once.

Rows are served one after another along shortest augmenting paths; prices of rows and columns keep all
reduced costs at zero or above, so each path is a walk over tight edges. The walks of all problems of a
batch advance together as arrays. Where several assignments cost the same, they are exactly those that
use tight edges alone, and the rule for ties is applied among them.
"""

from __future__ import annotations

import numpy as np

#: costs closer than this share of the largest one are equal
TIE = 1e-9


def _dense(problem: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of each value among the different ones of its problem."""
    order = np.lexsort((value, problem))
    p, v = problem[order], value[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    number = np.cumsum(new) - 1
    firsts = number[np.searchsorted(p, p)] if len(p) else number
    out = np.empty(len(p), np.int64)
    out[order] = number - firsts
    return out


def solve(cost: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of every row, and the prices of rows and columns.

    ``cost``: problems x rows x columns, at least as many columns as rows; ``rows``: how many rows of each
    problem count. Every row gets a column of its own at least total cost.
    """
    n_problems, n, m = cost.shape
    u, v = np.zeros((n_problems, n + 1)), np.zeros((n_problems, m + 1))
    owner, way = np.zeros((n_problems, m + 1), np.int64), np.zeros((n_problems, m + 1), np.int64)
    for row in range(1, n + 1):
        live = np.flatnonzero(rows >= row)
        if not len(live):
            break
        owner[live, 0] = row
        at = np.zeros(n_problems, np.int64)
        near = np.full((n_problems, m + 1), np.inf)
        seen = np.zeros((n_problems, m + 1), bool)
        walking = live
        while len(walking):
            seen[walking, at[walking]] = True
            of = owner[walking, at[walking]]
            now = cost[walking, of - 1] - u[walking, of][:, None] - v[walking, 1:]
            closer = ~seen[walking, 1:] & (now < near[walking, 1:])
            part = near[walking, 1:]
            part[closer] = now[closer]
            near[walking, 1:] = part
            back = way[walking, 1:]
            back[closer] = np.broadcast_to(at[walking][:, None], closer.shape)[closer]
            way[walking, 1:] = back
            open_ = np.where(seen[walking, 1:], np.inf, part)
            to = open_.argmin(axis=1)
            step = open_[np.arange(len(walking)), to]
            taken = seen[walking]
            np.add.at(u, (np.repeat(walking, taken.sum(1)), owner[walking][taken]), np.repeat(step, taken.sum(1)))
            v[walking] -= taken * step[:, None]
            near[walking] = np.where(taken, near[walking], near[walking] - step[:, None])
            at[walking] = to + 1
            walking = walking[owner[walking, to + 1] != 0]
        while len(live):
            before = way[live, at[live]]
            owner[live, at[live]] = owner[live, before]
            at[live] = before
            live = live[before != 0]
    column = np.full((n_problems, n + 1), -1)
    p, c = np.nonzero(owner[:, 1:])
    column[p, owner[p, c + 1]] = c
    return column[:, 1:], u[:, 1:], v[:, 1:]


def _grow(column: int, edges, partner: dict[int, int], tried: set[int]) -> bool:
    """Gives ``column`` a row, moving others if need be."""
    for row in sorted(edges[column]):
        if row not in tried:
            tried.add(row)
            if row not in partner or _grow(partner[row], edges, partner, tried):
                partner[row] = column
                return True
    return False


def _completes(rows: set[int], columns: set[int], edges: list[set[int]], real: int) -> bool:
    """Whether all ``columns`` find one of ``rows`` while every other row may do without a partner."""
    partner: dict[int, int] = {}
    left = {c: edges[c] & rows for c in columns}
    if not all(_grow(c, left, partner, set()) for c in sorted(columns)):
        return False

    def settle(row: int, tried: set[int]) -> bool:
        if row in edges[real + row]:
            partner.pop(row, None)
            return True
        for c in columns - tried:
            if row in left[c]:
                tried.add(c)
                other = next(r for r, x in partner.items() if x == c)
                if settle(other, tried):
                    partner[row] = c
                    return True
        return False

    return all(settle(r, set()) for r in sorted(rows) if r not in partner)


def smallest_tight(tight: np.ndarray, forced: np.ndarray, real: int) -> list[int]:
    """Of the assignments over tight edges the one with the smallest columns, then the smallest column for each row in turn.

    ``forced`` columns must be used; columns from ``real`` on stand for no partner, one for each row. The
    columns that can be used together form a matroid, so taking the smallest that still fits is right.
    """
    n, m = tight.shape
    edges = [set(np.flatnonzero(tight[:, c]).tolist()) for c in range(m)]
    used: list[int] = []
    partner: dict[int, int] = {}
    for c in [*np.flatnonzero(forced).tolist(), *np.flatnonzero(~forced).tolist()]:
        if len(used) < n and _grow(c, edges, partner, set()):
            used.append(c)
    columns, rows, out = {c for c in used if c < real}, set(range(n)), []
    for row in range(n):
        rows.remove(row)
        out.append(next((c for c in sorted(columns) if row in edges[c] and _completes(rows, columns - {c}, edges, real)), real + row))
        columns.discard(out[-1])
    return out


def cheapest(problem: np.ndarray, row: np.ndarray, column: np.ndarray, cost: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Which of the candidate pairs are chosen.

    Each candidate is a pair of a row and a column of a problem, with its cost; problems are numbered in
    ascending order from 0. As many rows as possible get a column of their own, at least total cost; of
    equal costs the smallest columns are used, then the first row gets the smallest column, and so on. Of
    repeated pairs the cheapest, then first, counts. Problems are solved together, at most ``cells``
    numbers at a time.
    """
    out = np.zeros(len(problem), bool)
    if not len(problem):
        return out
    r, c = _dense(problem, row), _dense(problem, column)
    count = int(problem.max()) + 1
    n_rows, n_columns = np.zeros(count, np.int64), np.zeros(count, np.int64)
    np.maximum.at(n_rows, problem, r + 1)
    np.maximum.at(n_columns, problem, c + 1)
    size, number = n_rows * (n_rows + n_columns), np.zeros(count, np.int64)
    begins = np.searchsorted(problem, np.arange(count + 1))
    # problems of about one size together, so that padding stays small
    order, lo = np.argsort(size, kind="stable"), 0
    while lo < count:
        some = order[lo : lo + (1 << 14)]
        n_most, m_most = np.maximum.accumulate(n_rows[some]), np.maximum.accumulate(n_columns[some])
        hi = lo + max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * n_most * (n_most + m_most), cells, side="right")))
        batch = order[lo:hi]
        lo = hi
        at = np.concatenate([np.arange(begins[b], begins[b + 1]) for b in batch])
        n, m = int(n_rows[batch].max()), int(n_columns[batch].max())
        # going without a column costs more than any assignment can
        none = 1.0 + 2.0 * n * float(np.abs(cost[at]).max())
        matrix = np.full((len(batch), n, m + n), np.inf)
        matrix[:, np.arange(n), m + np.arange(n)] = none
        number[batch] = np.arange(len(batch))
        where = np.full((len(batch), n, m), -1)
        last = at[np.lexsort((at, cost[at]))][::-1]  # of pairs that repeat the cheapest is written last
        where[number[problem[last]], r[last], c[last]] = last
        matrix[number[problem[at]], r[at], c[at]] = cost[where[number[problem[at]], r[at], c[at]]]
        matrix = np.where(np.isinf(matrix), 4 * none, matrix)
        column_of, u, v = solve(matrix, n_rows[batch])
        slack = matrix - u[:, :, None] - v[:, None, :]
        eps = TIE * none / max(1, n)
        counted = np.arange(n)[None, :] < n_rows[batch][:, None]
        tight = (slack <= eps) & counted[:, :, None] & (matrix < 2 * none)
        for b in np.flatnonzero(tight.sum((1, 2)) > n_rows[batch]):
            k = int(n_rows[batch[b]])
            keep = [*range(m), *range(m, m + k)]
            column_of[b, :k] = smallest_tight(tight[b, :k][:, keep], v[b, keep] < -eps, m)
        b, i = np.nonzero(counted & (column_of < m) & (column_of >= 0))
        found = where[b, i, column_of[b, i]]
        out[found[found >= 0]] = True
    return out
