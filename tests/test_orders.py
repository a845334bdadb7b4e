"""Orders of a board against all orders, larger boards, bounds and scenarios."""

from itertools import permutations

import numpy as np
import pytest

from presswarp.operators import consensus as co


def antisymmetric(rng, n, kind):
    m = rng.normal(size=(n, n))
    m = [m, np.round(m), np.sign(np.arange(n)[None, :] - np.arange(n)[:, None]) + 0.7 * m][kind]
    return np.triu(m, 1) - np.triu(m, 1).T


@pytest.mark.parametrize("kind", range(3))
def test_the_first_of_the_best_orders(kind):
    rng = np.random.default_rng(kind)
    for _ in range(60):
        m = antisymmetric(rng, int(rng.integers(1, 8)), kind)
        costs = {o: co.reversal_cost(m, list(o)) for o in permutations(range(len(m)))}
        least = min(costs.values())
        order, proven = co.best_order(m)
        assert proven and tuple(order) == min(o for o, c in costs.items() if c <= least + 1e-9)
        assert co.lower_bound(m) <= least + 1e-9


def held_karp(lose):
    """Plain dynamic programming over sets."""
    n = len(lose)
    tail = {(1 << n) - 1: 0.0}
    for s in range((1 << n) - 2, -1, -1):
        rest = [x for x in range(n) if not s >> x & 1]
        tail[s] = min(tail[s | 1 << x] + sum(lose[y, x] for y in rest if y != x) for x in rest)
    return tail[0]


def test_larger_boards():
    rng = np.random.default_rng(9)
    for n in (11, 13):
        m = antisymmetric(rng, n, 0)
        assert abs(co.reversal_cost(m, co.best_order(m)[0]) - held_karp(np.maximum(m, 0))) < 1e-9
    m = antisymmetric(rng, 20, 0)
    order, proven = co.best_order(m)
    assert proven and sorted(order) == list(range(20))
    for _ in range(2000):  # no move of a stretch is better
        a, b, c = sorted(rng.integers(0, 21, 3))
        assert co.reversal_cost(m, order[:a] + order[b:c] + order[a:b] + order[c:]) >= co.reversal_cost(m, order) - 1e-9


def test_parts_are_solved_by_themselves():
    """Sixty models in blocks of a clear order among each other: proven, though no table over all sets would fit."""
    rng = np.random.default_rng(10)
    m = np.triu(np.full((60, 60), 1.0), 1)
    m = m - m.T
    for k in range(0, 60, 10):
        m[k : k + 10, k : k + 10] = antisymmetric(rng, 10, 0)
    names = rng.permutation(60)
    shuffled = np.zeros((60, 60))
    shuffled[np.ix_(names, names)] = m
    order, proven = co.best_order(shuffled)
    assert proven
    want = [names[k + x] for k in range(0, 60, 10) for x in co.best_order(m[k : k + 10, k : k + 10])[0]]
    assert abs(co.reversal_cost(shuffled, order) - co.reversal_cost(shuffled, want)) < 1e-9 and [set(order[k : k + 10]) for k in range(0, 60, 10)] == [set(names[k : k + 10].tolist()) for k in range(0, 60, 10)]
    assert co.strong_parts(np.zeros((3, 3), bool)) == [[0], [1], [2]] and co.best_order(np.zeros((0, 0))) == ([], True)


def test_beyond_the_table(monkeypatch):
    rng = np.random.default_rng(11)
    for kind in (0, 2):
        m = antisymmetric(rng, 14, kind)
        best = co.reversal_cost(m, co.best_order(m)[0])
        monkeypatch.setattr(co, "EXACT", 6)
        order, proven = co.best_order(m)
        monkeypatch.undo()
        cost = co.reversal_cost(m, order)
        assert best - 1e-9 <= cost <= best * 1.02 + 1e-9 and co.lower_bound(m) <= best + 1e-9
        assert not proven or cost <= best + 1e-9


def test_scenarios(spark):
    pairs = spark.createDataFrame([("u1", 1, 2, 0.5, 1.0), ("u2", 1, 2, -1.0, 0.5), ("u3", 1, 2, 0.2, 2.0)], "unit string, a int, b int, p double, weight double")
    signs = spark.createDataFrame([("u1", 1, 2, 1.0, 1.0), ("u2", 1, 2, -1.0, 0.5), ("u3", 1, 2, 1.0, 2.0)], pairs.schema)
    got = {r.scenario: round(r.net, 9) for r in co.scenarios(pairs, ["u1", "u2", "u3"], {"u1": "x", "u2": "y", "u3": "x"}, signs).collect()}
    assert got == {"without:u1": -0.1, "without:u2": 0.9, "without:u3": 0.0, "operator:x": -0.5, "operator:y": 0.9, "less:u1": 0.3, "less:u2": 0.5, "less:u3": 0.32, "more:u1": 0.5, "more:u2": 0.3, "more:u3": 0.48, "ordinal": 2.5}
