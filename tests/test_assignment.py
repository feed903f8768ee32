"""Assignments against all permutations, and against known minima of large problems."""

import itertools
import random
import time

import numpy as np
import pytest

from gaugeframe.operators.assignment import cheapest, solve


def by_permutations(pairs):
    """Most rows, least cost, then smallest columns, then smallest partner of each row; whole numbers, so ties are exact."""
    rows, columns = sorted({r for r, _, _ in pairs}), sorted({c for _, c, _ in pairs})
    cost = {}
    for r, c, x in pairs:
        cost[r, c] = min(x, cost.get((r, c), x))
    best = None
    for k in range(min(len(rows), len(columns)), -1, -1):
        for some in itertools.combinations(rows, k):
            for way in itertools.permutations(columns, k):
                if all(p in cost for p in zip(some, way)):
                    rank = sum(cost[p] for p in zip(some, way)), sorted(way), list(zip(some, way))
                    best = rank if best is None or rank < best else best
        if best is not None:
            return best
    return best


@pytest.mark.parametrize("seed", range(6))
def test_equals_permutations_with_ties(seed):
    r = random.Random(seed)
    problems = []
    for _ in range(60):
        n, m = r.randrange(1, 5), r.randrange(1, 6)
        pairs = [(i * 3, j * 2 + 1, float(r.randrange(4))) for i in range(n) for j in range(m) if r.random() < 0.8]
        problems.append(pairs or [(0, 1, 1.0)])
        r.shuffle(problems[-1])
    problems[7] = problems[7] + problems[7][:2]  # pairs that repeat
    flat = [(k, *p) for k, ps in enumerate(problems) for p in ps]
    for cells in (1, 1 << 21):
        chosen = cheapest(*(np.array(x) for x in zip(*flat)), cells=cells)
        for k, pairs in enumerate(problems):
            got = sorted((f[1], f[2], f[3]) for f, y in zip(flat, chosen) if y and f[0] == k)
            want = by_permutations(pairs)
            assert [g[:2] for g in got] == want[2] and sum(g[2] for g in got) == want[0]


def test_seven_rows_equal_permutations():
    cost = np.random.default_rng(1).random((4, 7, 7))
    column, _, _ = solve(cost, np.full(4, 7))
    for k in range(4):
        least = min(sum(cost[k, i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(7)))
        assert abs(cost[k, np.arange(7), column[k]].sum() - least) < 1e-12


def test_sixty_four_rows():
    """The prices prove the minimum: no reduced cost is negative, and the price of an unused column is zero."""
    r = np.random.default_rng(2)
    cost = r.random((20, 64, 128)) * 100
    t = time.perf_counter()
    column, u, v = solve(cost, np.full(20, 64))
    assert time.perf_counter() - t < 20 * 0.25
    slack = cost - u[:, :, None] - v[:, None, :]
    assert slack.min() > -1e-9 and v.max() <= 0
    for k in range(20):
        assert len(set(column[k])) == 64 and np.abs(slack[k, np.arange(64), column[k]]).max() < 1e-9
        assert np.abs(np.delete(v[k], column[k])).max() == 0


def test_equal_colours_everywhere():
    """All costs equal: the first columns in turn, also for a palette of 64."""
    e, o = (x.ravel() for x in np.meshgrid(np.arange(64), np.arange(70), indexing="ij"))
    chosen = cheapest(np.zeros(len(e), int), e, o, np.full(len(e), 3.5))
    assert (e[chosen] == np.arange(64)).all() and (o[chosen] == np.arange(64)).all()
    assert not cheapest(*(np.zeros(0, int),) * 3, np.zeros(0)).any()
