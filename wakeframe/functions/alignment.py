"""Pairwise series distances in numpy, vectorised over the pairs of an Arrow batch."""

from __future__ import annotations

import numpy as np


def _by_shape(a, b):
    shapes = np.array([(len(x), len(y)) for x, y in zip(a, b)])
    for n, m in np.unique(shapes, axis=0) if len(shapes) else []:
        at = np.flatnonzero((shapes == (n, m)).all(axis=1))
        if n and m:
            yield at, np.stack([np.asarray(a[i], float) for i in at]), np.stack([np.asarray(b[i], float) for i in at])


def _sweep(x: np.ndarray, y: np.ndarray, cost, step) -> np.ndarray:
    """Dynamic programme over anti-diagonals; only three diagonals are kept."""
    k, n, m = len(x), x.shape[1], y.shape[1]
    last = np.full((k, n + 1), np.inf)
    older = last.copy()
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        c = cost(i, s - i)
        now = np.full((k, n + 1), np.inf)
        if s == 0:
            now[:, 1] = c[:, 0]
        else:
            now[:, i + 1] = step(last[:, i + 1], last[:, i], older[:, i], c)
        older, last = last, now
    return last[:, n]


def dtw(a, b) -> np.ndarray:
    """Dynamic time warping: unit weight for a side step, double for a diagonal one."""
    out = np.full(len(a), np.nan)
    for at, x, y in _by_shape(a, b):
        out[at] = _sweep(
            x, y,
            lambda i, j: np.abs(x[:, i] - y[:, j]),
            lambda up, left, diag, c: np.minimum(np.minimum(up, left) + c, diag + 2 * c),
        )
    return out


def frechet(a, b, reach: float = 1.0) -> np.ndarray:
    """Discrete Frechet distance of the curves (time, value), time running -reach..reach."""
    out = np.full(len(a), np.nan)
    for at, x, y in _by_shape(a, b):
        tx, ty = np.linspace(-reach, reach, x.shape[1]), np.linspace(-reach, reach, y.shape[1])
        out[at] = _sweep(
            x, y,
            lambda i, j: np.hypot(tx[i] - ty[j], x[:, i] - y[:, j]),
            lambda up, left, diag, c: np.maximum(np.minimum(np.minimum(up, left), diag), c),
        )
    return out


def correlate(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Largest normalised cross-correlation over all lags, and its (first) lag; NaN for a flat series."""
    best, lag = np.full(len(a), np.nan), np.full(len(a), np.nan)
    for at, x, y in _by_shape(a, b):
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        n, m = x.shape[1], y.shape[1]
        norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        size = n + m - 1
        full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
        full = np.roll(full, m - 1, axis=1)
        # Lags equal up to the transform's rounding count as one maximum: the first wins.
        top = full.max(axis=1, keepdims=True)
        k = (full >= top - 1e-12 * np.abs(top)).argmax(axis=1)
        ok = norm > 0
        best[at[ok]] = full[ok, k[ok]] / norm[ok]
        lag[at[ok]] = k[ok] - (m - 1)
    return best, lag


def best_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of largest normalised cross-correlations between the rows of x and of y."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    size = x.shape[1] + y.shape[1] - 1
    fx, fy = np.fft.rfft(x, size), np.conj(np.fft.rfft(y, size))
    top = np.stack([np.fft.irfft(fx[i] * fy, size).max(axis=1) for i in range(len(x))])
    norm = np.sqrt((x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)[None])
    return np.divide(top, norm, out=np.full_like(top, np.nan), where=norm > 0)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on a Simpson-integrated density."""
    from math import exp, lgamma, pi, sqrt

    scale = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)

    def upper(x):
        u = np.linspace(0.0, x, 4001)
        f = scale * (1 + u * u / df) ** (-(df + 1) / 2)
        return 0.5 + (x / 4000) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())

    low, high = 0.0, 1.0
    while upper(high) < p and high < 1e6:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) < p else (low, mid)
    return (low + high) / 2
