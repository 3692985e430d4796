"""Best pairing of groups against all pairings, and against the bound of a dual solution for larger ones."""

import itertools
import random

import numpy as np
import pytest

from riskloom.operators import assignment, compare


def best_sum(m):
    """Largest sum of a matrix with no row and no column twice, by all permutations of the longer side."""
    m = m if m.shape[0] <= m.shape[1] else m.T
    return max(sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m.shape[1]), m.shape[0]))


def shortest_paths(m):
    """The same by successive shortest augmenting paths with prices; returns the sum and the prices' bound."""
    n = max(m.shape)
    cost = np.zeros((n, n))
    cost[: m.shape[0], : m.shape[1]] = -m
    u, v, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for i in range(n):
        dist, last, done, j, row = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), -1, i
        while True:
            reach = cost[row] - u[row] - v + (dist[j] if j >= 0 else 0)
            better = ~done & (reach < dist)
            dist[better], last[better] = reach[better], j
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            row = owner[j]
        end = dist[j]
        for k in np.flatnonzero(done):
            v[k] += dist[k] - end
            if owner[k] >= 0 and k != j:
                u[owner[k]] += end - dist[k]
        u[i] += end
        while j >= 0:
            owner[j] = owner[last[j]] if last[j] >= 0 else i
            j = last[j]
    return -sum(cost[owner[j], j] for j in range(n)), -(u.sum() + v.sum())


def as_table(spark, m):
    rows = [(f"a{i}", j, int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]]
    return spark.createDataFrame(rows, "a_group STRING, b_group INT, n BIGINT")


def checked(spark, m):
    pairs = assignment.best_pairs(as_table(spark, m)).collect()
    assert len({r.a_group for r in pairs}) == len(pairs) == len({r.b_group for r in pairs})
    assert all(m[int(r.a_group[1:]), int(r.b_group)] == r.n for r in pairs)
    return sum(r.n for r in pairs)


@pytest.mark.parametrize("shape,seed", [((4, 4), 1), ((3, 6), 2), ((6, 2), 3)])
def test_pairs_equal_all_permutations(spark, shape, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 30, shape) * (rng.random(shape) < 0.7)
    m[0, 0] = max(m[0, 0], 1)
    assert checked(spark, m) == best_sum(m)


def test_larger_groupings_reach_the_dual_bound(spark):
    rng = np.random.default_rng(7)
    m = rng.integers(0, 60, (9, 8)) * (rng.random((9, 8)) < 0.6)
    total, bound = shortest_paths(m)
    assert total == pytest.approx(bound)
    assert checked(spark, m) == total


def test_agreement_of_groupings(spark):
    rng = random.Random(3)
    a = [(i, f"g{rng.randrange(4)}") for i in range(60)]
    b = [(i, g if rng.random() < 0.7 else f"g{rng.randrange(5)}") for i, g in a if i < 55] + [(100, "new")]
    frame = lambda rows: spark.createDataFrame(rows, "path BIGINT, grp STRING")
    x, y = frame(a), frame(b)
    row = assignment.agreement(x, y, compare.grouping_overlap(x, y)).first()
    of_a, of_b = dict(a), dict(b)
    names_a, names_b = sorted(set(of_a.values())), sorted(set(of_b.values()))
    m = np.array([[sum(of_a.get(i) == g and of_b[i] == h for i in of_b) for h in names_b] for g in names_a])
    kept = best_sum(m)
    changes = abs(len(names_a) - len(names_b)) + m.sum() - kept + 2 * (len(a) + len(b) - 2 * m.sum())
    assert (row.a_groups, row.b_groups, row.shared, row.kept, row.changes) == (len(names_a), len(names_b), m.sum(), kept, changes)
    assert row.a2a == pytest.approx(100 * (1 - changes / (len(names_a) + len(names_b) + 2 * (len(a) + len(b)))))
    same = assignment.agreement(x, x, compare.grouping_overlap(x, x)).first()
    assert same.a2a == 100 and same.changes == 0
    none = assignment.agreement(x.limit(0), x.limit(0), compare.grouping_overlap(x.limit(0), x.limit(0))).first()
    assert none.kept == 0 and none.a2a is None
