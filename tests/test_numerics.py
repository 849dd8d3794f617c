"""Numpy helpers against plain loops."""

import numpy as np
import pytest

from wakeframe.functions import alignment, filters
from wakeframe.operators.contours import periodic_spline
from wakeframe.operators.modal import threshold_least_squares
from wakeframe.operators.tracks import Linker
from wakeframe.operators.vortices import component_ids

RNG = np.random.default_rng(3)


def flood(mask):
    nx, ny = mask.shape
    out = np.full(mask.shape, -1)
    for y in range(ny):
        for x in range(nx):
            if mask[x, y] and out[x, y] < 0:
                todo = [(x, y)]
                out[x, y] = y * nx + x
                while todo:
                    i, j = todo.pop()
                    for p, q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                        if 0 <= p < nx and 0 <= q < ny and mask[p, q] and out[p, q] < 0:
                            out[p, q] = y * nx + x
                            todo.append((p, q))
    return out


def test_components_match_flood_fill():
    masks = RNG.random((30, 17, 11)) < 0.55
    masks[0], masks[1] = True, False
    got = component_ids(masks)
    for m, g in zip(masks, got):
        np.testing.assert_array_equal(g, flood(m))


def direct(x, s, b, a):
    y, s = np.empty(len(x)), s.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + s[0]
        s[:-1] = s[1:]
        s[-1] = 0
        s += b[1:] * v - a[1:] * y[i]
    return y, s


@pytest.mark.parametrize("spec", [(2, 5.0, "low"), (4, 1.0, "high"), (2, (0.3, 9.0), "band"), (3, 8.0, "low")])
def test_block_filter_matches_recursion(spec):
    b, a = filters.butterworth(*spec, 100.0)
    x, s = RNG.normal(size=1000), RNG.normal(size=len(a) - 1)
    y, end = filters.run_block(x[None], s[None], b, a)
    want, last = direct(x, s, b, a)
    np.testing.assert_allclose(y[0], want, atol=1e-8)
    np.testing.assert_allclose(end[0], last, atol=1e-8)


def test_butterworth_known_taps_and_gains():
    b, a = filters.butterworth(2, 5.0, "low", 100.0)
    np.testing.assert_allclose(b, [0.02008337, 0.04016673, 0.02008337], atol=1e-8)
    np.testing.assert_allclose(a, [1.0, -1.56101808, 0.64135154], atol=1e-8)
    b, a = filters.butterworth(2, (0.3, 9.0), "band", 100.0)
    assert abs(b.sum()) < 1e-12
    y = filters.both_ways(np.full((1, 400), 7.0), b, a)
    np.testing.assert_allclose(y, 0, atol=1e-6)


def test_natural_spline_matches_dense_solve():
    rows = RNG.normal(size=(3, 9))
    n, h = 9, 1 / 8
    system = np.eye(n)
    rhs = np.zeros((n, 3))
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = [1, 4, 1]
        rhs[i] = 6 * (rows[:, i + 1] - 2 * rows[:, i] + rows[:, i - 1]) / h**2
    m = np.linalg.solve(system, rhs).T
    at = np.linspace(0, 1, 33)
    k = np.minimum((at / h).astype(int), n - 2)
    u, t = (k + 1) * h - at, at - k * h
    want = (m[:, k] * u**3 + m[:, k + 1] * t**3) / (6 * h) + (rows[:, k] / h - m[:, k] * h / 6) * u + (rows[:, k + 1] / h - m[:, k + 1] * h / 6) * t
    np.testing.assert_allclose(filters.natural_spline(rows, 33), want, atol=1e-10)


def loop_pairs(a, b, cost, step):
    d = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            c = cost(i, j)
            if i == j == 0:
                d[i, j] = c
                continue
            up = d[i, j - 1] if j else np.inf
            left = d[i - 1, j] if i else np.inf
            diag = d[i - 1, j - 1] if i and j else np.inf
            d[i, j] = step(up, left, diag, c)
    return d[-1, -1]


def test_dtw_and_frechet_match_loops():
    a = [RNG.normal(size=n) for n in (5, 9, 9, 1)]
    b = [RNG.normal(size=n) for n in (7, 4, 4, 6)]
    dtw = [loop_pairs(x, y, lambda i, j: abs(x[i] - y[j]), lambda u, l, d, c: min(u + c, l + c, d + 2 * c)) for x, y in zip(a, b)]
    np.testing.assert_allclose(alignment.dtw(a, b), dtw)
    assert (alignment.dtw(a, a) == 0).all()
    for x, y, got in zip(a, b, alignment.frechet(a, b)):
        tx, ty = np.linspace(-1, 1, len(x)), np.linspace(-1, 1, len(y))
        want = loop_pairs(x, y, lambda i, j: np.hypot(tx[i] - ty[j], x[i] - y[j]), lambda u, l, d, c: max(min(u, l, d), c))
        assert got == pytest.approx(want)


def test_correlation_matches_numpy():
    a, b = [RNG.normal(size=30)], [RNG.normal(size=12)]
    x, y = a[0] - a[0].mean(), b[0] - b[0].mean()
    full = np.correlate(x, y, "full") / np.sqrt((x * x).sum() * (y * y).sum())
    best, lag = alignment.correlate(a, b)
    assert best[0] == pytest.approx(full.max())
    assert lag[0] == full.argmax() - 11
    best, lag = alignment.correlate([a[0], np.ones(4)], [a[0], np.ones(4)])
    assert best[0] == pytest.approx(1) and lag[0] == 0 and np.isnan(best[1])


def test_sine_against_cosine():
    t = np.linspace(0, 4 * np.pi, 200)
    best, _ = alignment.correlate([np.sin(t)], [np.cos(t)])
    assert 0.8 < best[0] < 1


def test_t_quantile():
    assert alignment.t_quantile(0.995, 48) == pytest.approx(2.682204, abs=1e-5)
    assert alignment.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)


def test_periodic_spline_keeps_the_vertices():
    angle = np.arange(16) * 2 * np.pi / 16
    x, y = np.cos(angle), np.sin(angle)
    px, py = periodic_spline(x, y, 16 * 4 + 1)
    np.testing.assert_allclose(px[::4], np.append(x, x[0]), atol=1e-9)
    np.testing.assert_allclose(np.hypot(px, py), 1, atol=2e-3)


def test_sparse_fit_recovers_a_linear_system():
    x = RNG.normal(size=(500, 2))
    theta = np.column_stack([np.ones(500), x, x[:, :1] ** 2])
    truth = np.array([[0, 0], [-0.5, 2.0], [1.5, 0], [0, -0.7]])
    coef = threshold_least_squares(theta.T @ theta, theta.T @ (theta @ truth), 0.1)
    np.testing.assert_allclose(coef, truth, atol=1e-8)


def test_linker_expires_and_takes_shortest_first():
    link = Linker(2.0, 1)
    ids, _ = link.step(0, np.array([[0.0, 0.0], [3.0, 0.0]]))
    assert ids.tolist() == [0, 1]
    # Both tracks want the first detection; the nearer one gets it, the other starts nothing.
    ids, dist = link.step(1, np.array([[1.9, 0.0], [9.0, 9.0]]))
    assert ids.tolist() == [1, 2] and dist[0] == pytest.approx(1.1) and np.isnan(dist[1])
    ids, _ = link.step(3, np.array([[1.9, 0.0]]))
    assert ids.tolist() == [3]
