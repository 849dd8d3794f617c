"""Digital filter design and block-wise evaluation in numpy (small helpers for the tasks)."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cutoff, kind: str, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth coefficients (b, a): analog prototype, frequency transform, bilinear map.

    ``cutoff`` is a frequency in Hz for ``low`` / ``high`` and a pair for ``band``.
    """
    w = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / fs)
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    proto = np.exp(1j * angles)
    if kind == "low":
        poles, zeros, gain = proto * w[0], np.empty(0), w[0] ** order
    elif kind == "high":
        poles, zeros, gain = w[0] / proto, np.zeros(order), 1.0
    elif kind == "band":
        width, centre2 = w[1] - w[0], w[0] * w[1]
        half = proto * width / 2
        root = np.sqrt(half**2 - centre2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    else:
        raise ValueError(f"unknown filter kind {kind}")
    k = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    b = np.real(np.poly(z)) * k
    a = np.real(np.poly((4 + poles) / (4 - poles)))
    return b, a


def state_space(b, a):
    """Transposed direct form as (A, B, C, D): s' = A s + B x, y = C s + D x."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    m = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, m + 1 - len(b))), np.pad(a, (0, m + 1 - len(a)))
    step = np.zeros((m, m))
    step[:, 0] = -a[1:]
    step[np.arange(m - 1), np.arange(1, m)] = 1.0
    c = np.zeros(m)
    c[0] = 1.0
    return step, b[1:] - a[1:] * b[0], c, b[0]


def steady_state(b, a) -> np.ndarray:
    """Filter state that answers a constant input of 1 with its steady output at once."""
    step, gain, _, _ = state_space(b, a)
    return np.linalg.solve(np.eye(len(gain)) - step, gain)


def modes(b, a):
    """Eigen-form of the state step: (poles, V, V^-1). Butterworth poles are distinct."""
    poles, vectors = np.linalg.eig(state_space(b, a)[0])
    return poles, vectors, np.linalg.inv(vectors)


def advance(b, a, n: int) -> np.ndarray:
    """The state step taken ``n`` times without input."""
    poles, vectors, back = modes(b, a)
    return np.real((vectors * poles**n) @ back)


def run_block(x: np.ndarray, state: np.ndarray, b, a, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Filter rows of ``x`` (k, n) from ``state`` (k, m); returns outputs and final states.

    The samples go in blocks of ``size`` through matrix products, so only one step
    per block is sequential. The state runs along the poles: powers of a pole stay
    small, whereas powers of the step matrix itself lose digits.
    """
    step, gain, c, d = state_space(b, a)
    poles, vectors, back = modes(b, a)
    out_gain, in_gain = c @ vectors, back @ gain
    n = x.shape[1]
    ladder = poles[None, :] ** np.arange(size + 1)[:, None]
    impulse = np.concatenate([[d], np.real(ladder[: size - 1] @ (out_gain * in_gain))])
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    toeplitz = np.where(lag >= 0, impulse[np.abs(lag)], 0.0)
    observe, control = ladder[:size] * out_gain, ladder[size - 1 :: -1] * in_gain
    out = np.empty(x.shape)
    whole = n - n % size
    q = state @ back.T
    if whole:
        blocks = x[:, :whole].reshape(len(x), -1, size)
        y = blocks @ toeplitz.T
        feed = blocks @ control
        for k in range(blocks.shape[1]):
            y[:, k] += np.real(q @ observe.T)
            q = q * ladder[size] + feed[:, k]
        out[:, :whole] = y.reshape(len(x), whole)
    s = np.real(q @ vectors.T)
    for i in range(whole, n):
        out[:, i] = s @ c + d * x[:, i]
        s = s @ step.T + x[:, i, None] * gain
    return out, s


def run_rows(rows: list[np.ndarray], states: np.ndarray, b, a) -> tuple[list[np.ndarray], np.ndarray]:
    """``run_block`` for rows of unequal length: equal lengths go together."""
    out: list = [None] * len(rows)
    final = np.empty_like(states)
    lengths = np.array([len(r) for r in rows])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        y, s = run_block(np.stack([rows[i] for i in at]).astype(float), states[at], b, a)
        final[at] = s
        for i, r in zip(at, y):
            out[i] = r
    return out, final


def both_ways(x: np.ndarray, b, a) -> np.ndarray:
    """Forward-backward filter of rows of ``x`` with odd extension (short, bounded rows)."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError("series shorter than the filter's edge extension")
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    ext = np.concatenate([left, x, right], axis=1)
    zi = steady_state(b, a)
    y, _ = run_block(ext, ext[:, :1] * zi, b, a)
    y, _ = run_block(y[:, ::-1], y[:, -1:] * zi, b, a)
    return y[:, ::-1][:, pad:-pad]


def natural_spline(rows: np.ndarray, length: int) -> np.ndarray:
    """Natural cubic spline of equally spaced rows, evaluated at ``length`` points on [0, 1]."""
    k, n = rows.shape
    h = 1.0 / (n - 1)
    second = np.zeros((k, n))
    rhs = 6 * (rows[:, 2:] - 2 * rows[:, 1:-1] + rows[:, :-2]) / h**2
    diag, carry = np.full(n - 2, 4.0), rhs.copy()
    for i in range(1, n - 2):
        f = 1.0 / diag[i - 1]
        diag[i] -= f
        carry[:, i] -= f * carry[:, i - 1]
    for i in range(n - 3, -1, -1):
        nxt = second[:, i + 2] if i + 2 < n - 1 else 0.0
        second[:, i + 1] = (carry[:, i] - nxt) / diag[i]
    at = np.linspace(0.0, 1.0, length) / h
    lo = np.minimum(at.astype(int), n - 2)
    t, u = at - lo, 1 - (at - lo)
    return (
        u * rows[:, lo]
        + t * rows[:, lo + 1]
        + ((u**3 - u) * second[:, lo] + (t**3 - t) * second[:, lo + 1]) * h**2 / 6
    )
