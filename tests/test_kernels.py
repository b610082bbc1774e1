import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from itertools import permutations

from weftline.functions import kernels as k


def random_window(seed, rows=30, n=6):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((rows, n)) + rng.standard_normal((rows, 1)) * rng.uniform(0, 1.5)


def test_triangle_of_ones():
    a = np.ones((3, 3)) - np.eye(3)
    mass, c, d, v = k.parts(a)
    assert (mass, c, d, v) == (6, 1, 1, 0)
    assert k.spectral_gap(a) == pytest.approx(3)
    assert k.omega(a) == 0


def test_six_points_on_a_circle_have_one_loop():
    t = np.arange(6) * np.pi / 3
    p = np.c_[np.cos(t), np.sin(t)]
    pairs = k.rips_pairs(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)))
    assert len([x for x in pairs if x[0] == 1]) == 1


def test_constant_column_has_no_correlation():
    x = random_window(1)
    x[:, 2] = 5
    c = k.correlation(x)
    assert np.all(c[2] == 0) and np.isfinite(c).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_invariants(seed):
    x = random_window(seed)
    c = k.correlation(x)
    s = k.off_diagonal(c)
    assert np.allclose(c, np.corrcoef(x, rowvar=False))
    assert 1 - 1e-9 <= k.effective_rank(c) <= len(c) + 1e-9
    assert 0 < k.absorption(x, 1) <= 1
    assert 0 < k.balance(s) <= 1 + 1e-12
    e = np.linalg.eigvalsh
    assert k.balance(s) == pytest.approx(np.exp(e(s)).sum() / np.exp(e(np.abs(s))).sum())
    assert np.all(k.local_balance(s) <= 1 + 1e-9)


def test_balance_with_a_constant_diagonal():
    s = k.off_diagonal(k.correlation(random_window(3)))
    assert k.balance(s) == pytest.approx(k.balance(s + np.eye(len(s))))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_earth_mover_of_unit_masses_is_the_best_assignment(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((4, 4))
    best = min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(4)))
    assert k.transport(np.full(4, 0.25), np.full(4, 0.25), cost) == pytest.approx(best / 4)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_mass_that_both_have_stays(seed):
    rng = np.random.default_rng(seed)
    p, q, x = rng.random(9), rng.random(9), rng.random((9, 2))
    p, q, d = p / p.sum(), q / q.sum(), np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert k.earth_mover(p, q, d) == pytest.approx(k.transport(p, q, d))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 14))
def test_loops_of_many_points_equal_those_of_all_simplices(seed, n):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 2)), 1 if seed % 2 else 9)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    clean = lambda pairs: sorted((dim, round(b, 9), round(e, 9)) for dim, b, e in pairs if e > b + 1e-12)
    assert clean(k.loops_and_parts(d)) == clean(k.rips_pairs(d))


def test_loops_of_a_large_circle():
    t = np.arange(120) * 2 * np.pi / 120
    p = np.c_[np.cos(t), np.sin(t)]
    loops = [x for x in k.loops_and_parts(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))) if x[0] == 1]
    assert len(loops) == 1 and loops[0][2] == pytest.approx(3**0.5)


def test_earth_mover_of_uneven_masses():
    cost = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert k.earth_mover(np.array([0.9, 0.1]), np.array([0.3, 0.7]), cost) == pytest.approx(0.6)


def test_shrinkage_and_weights():
    x = random_window(5, 80, 8)
    s = np.cov(x, rowvar=False)
    for t in ("identity", "constant", "degree", "triadic"):
        assert np.allclose(np.diag(k.shrink_target(s, t)).mean(), np.diag(s).mean())
    assert k.minimum_variance(s).sum() == pytest.approx(1)
    assert np.all(np.linalg.eigvalsh(k.nonlinear_shrinkage(x)) > 0)
    b, d = k.factor_model(k.correlation(x), len(x))
    assert np.allclose((b * b).sum(1) + d, 1, atol=1e-5) or (d >= 1e-6).all()


def shortest_paths(supply: np.ndarray, need: np.ndarray, c: np.ndarray) -> float:
    """Least cost of moving ``supply`` to ``need``: successive shortest paths.

    Path lengths over the residual arcs are relaxed for all nodes at once until they settle. Exact; each
    path uses up a supply, a demand or an arc.
    """
    supply, need = supply.astype(float).copy(), need.astype(float).copy()
    if not len(supply) or not len(need):
        return 0.0
    flow, every_row, every_column = np.zeros(c.shape), np.arange(len(supply)), np.arange(len(need))
    while supply.max() > 1e-12 and need.max() > 1e-12:
        left = np.where(supply > 1e-13, 0.0, np.inf)
        right, from_left, from_right = np.full(len(need), np.inf), np.zeros(len(need), int), np.full(len(supply), -1)
        back_cost = np.where(flow > 1e-13, -c, np.inf)
        while True:
            by = left[:, None] + c
            best = by.argmin(axis=0)
            reach = by[best, every_column]
            nearer = reach < right - 1e-13
            right[nearer], from_left[nearer] = reach[nearer], best[nearer]
            by = right[None, :] + back_cost
            best = by.argmin(axis=1)
            reach = by[every_row, best]
            nearer = reach < left - 1e-13
            if not nearer.any():
                break
            left[nearer], from_right[nearer] = reach[nearer], best[nearer]
        j = int(np.where(need > 1e-13, right, np.inf).argmin())
        forth, back, at = [], [], j
        while True:
            i = int(from_left[at])
            forth.append((i, at))
            if supply[i] > 1e-13 and from_right[i] < 0:
                break
            at = int(from_right[i])
            back.append((i, at))
        amount = min([supply[i], need[j], *(flow[x] for x in back)])
        for x in forth:
            flow[x] += amount
        for x in back:
            flow[x] -= amount
        supply[i] -= amount
        need[j] -= amount
    return float((flow * c).sum())


def edge_problems(seed, n, rows, edges):
    """Transports of a window's edges, as curvature makes them."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, n)) + rng.standard_normal((rows, 1)) * rng.uniform(0, 1.5, n)
    c = k.correlation(x)
    a, d = np.abs(k.off_diagonal(c)), k.distance(c)
    np.fill_diagonal(d, 0)
    measure = a / a.sum(axis=1, keepdims=True)
    for _ in range(edges):
        i, j = rng.choice(n, 2, replace=False)
        gain = measure[i] - measure[j]
        p, q = np.flatnonzero(gain > 1e-15), np.flatnonzero(gain < -1e-15)
        yield gain[p], -gain[q], d[np.ix_(p, q)]


def test_simplex_equals_shortest_paths_on_60_nodes():
    for supply, need, cost in edge_problems(4, 60, 60, 12):
        assert k.transport(supply, need, cost) == pytest.approx(shortest_paths(supply, need, cost), abs=1e-9)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_simplex_on_ties_and_odd_shapes(seed):
    """Equal supplies, equal and zero costs, one row or one column."""
    rng = np.random.default_rng(seed)
    m, n = rng.integers(1, 9, 2)
    supply, need = rng.integers(1, 4, m).astype(float), rng.integers(1, 4, n).astype(float)
    cost = rng.integers(0, 3, (m, n)).astype(float) if seed % 2 else rng.random((m, n))
    supply, need = supply / supply.sum(), need / need.sum()
    assert k.transport(supply, need, cost) == pytest.approx(shortest_paths(supply, need, cost), abs=1e-9)
    assert k.transport(supply[:0], need[:0], cost[:0, :0]) == 0.0


def test_curvature_of_464_nodes_takes_milliseconds_an_edge():
    problems = list(edge_problems(1, 464, 250, 12))
    began = time.perf_counter()
    for p in problems:
        k.transport(*p)
    assert (time.perf_counter() - began) / len(problems) < 0.15  # about 0.02 on an idle core; successive shortest paths took 1.8


def test_targets_as_defined():
    """The degree target's correlations are all 1; the triadic ones are the cosines of the rows of absolute correlations."""
    x = random_window(7, 60, 5)
    s = np.cov(x, rowvar=False)
    sd = np.sqrt(np.diag(s))
    a = np.abs(k.off_diagonal(k.correlation(x)))
    cosines = a @ a / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(a, axis=1))
    assert np.allclose(k.shrink_target(s, "degree"), np.outer(sd, sd))
    assert np.allclose(k.shrink_target(s, "triadic"), cosines * np.outer(sd, sd))


def test_minimum_variance_has_equal_marginal_variances():
    """At the least variance every node adds as much: the covariance times the weights is constant."""
    s = np.cov(random_window(11, 80, 6), rowvar=False)
    w = k.minimum_variance(s)
    assert np.ptp(s @ w) < 1e-9 and w.sum() == pytest.approx(1)
    assert np.isfinite(k.minimum_variance(np.ones((3, 3)))).all()
