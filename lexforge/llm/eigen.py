"""Eigenvalues and eigenvectors of a symmetric matrix: Householder reduction to tridiagonal form, then divide and conquer.

The tridiagonal matrix is torn into two halves by a rank-one term; their solutions are joined by the roots of the secular
equation, found by bisection from the nearer pole, with vectors from weights made to fit those very roots, so that
they are orthogonal however close the roots are. Entries that the rank-one term doesn't touch are set aside.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q T q'."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if not size or not np.abs(x[1:]).max():
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = x - 2 * v * (v @ x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' for rising distinct d, z without zeros and rho > 0."""
    n = len(d)
    z2 = rho * z * z
    top = np.append(d[1:], d[-1] + z2.sum())
    gap = top - d
    middle = 1 + (z2[None, :] / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    low = middle > 0  # the root lies in the lower half, so it is counted from d[i]; else from the pole above
    low[-1] = True
    base = np.where(low, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    shifted = d[None, :] - d[base][:, None]
    a, b = np.where(low, 0.0, -gap / 2), np.where(low, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    for _ in range(1100):
        mid = (a + b) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + (z2[None, :] / (shifted - mid[:, None])).sum(axis=1)
        if np.all((mid == a) | (mid == b) | (b - a <= EPS * np.abs(mid) / 2)):
            break
        a, b = np.where(f < 0, mid, a), np.where(f < 0, b, mid)
    mu = (a + b) / 2
    minus = shifted - mu[:, None]  # [i, j]: d[j] - root i, to full relative precision
    ratio = np.empty(n)
    for j in range(n):
        others = np.delete(np.arange(n), j)
        # the root below each pole but the last is paired with that pole
        pair = np.where(others < j, others, others - 1)
        ratio[j] = -minus[n - 1, j] * np.prod(minus[pair, j] / (d[j] - d[others]))
    fit = np.copysign(np.sqrt(np.abs(ratio)), z)
    vectors = (fit[None, :] / minus).T
    return d[base] + mu, vectors / np.linalg.norm(vectors, axis=0)


def _joined(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q'."""
    if rho < 0:
        values, vectors = _joined(-d, z, -rho, q)
        return -values, vectors
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order].copy(), q[:, order].copy()
    size = np.linalg.norm(z)
    z, rho = z / size, rho * size * size
    least = 8 * EPS * max(np.abs(d).max(), rho)
    live = []
    for j in range(len(d)):
        if rho * abs(z[j]) <= least:
            continue
        if live and (d[j] - d[live[-1]]) * abs(z[j] * z[live[-1]]) / (z[j] ** 2 + z[live[-1]] ** 2) <= least:
            i = live.pop()  # turn the two, so that only one of them is touched
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
            d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
            z[i], z[j] = 0.0, r
        live.append(j)
    values, vectors = d.copy(), q
    if live:
        at = np.array(live)
        at = at[np.argsort(d[at], kind="stable")]
        values[at], turn = secular(d[at], z[at], rho)
        vectors[:, at] = q[:, at] @ turn
    return values, vectors


def conquer(diagonal: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(diagonal)
    if n == 1:
        return diagonal.astype(float), np.ones((1, 1))
    m = n // 2
    rho = off[m - 1]
    if not rho:
        (d1, q1), (d2, q2) = conquer(diagonal[:m], off[: m - 1]), conquer(diagonal[m:], off[m:])
    else:
        one, two = diagonal[:m].astype(float), diagonal[m:].astype(float)
        one[-1] -= rho
        two[0] -= rho
        (d1, q1), (d2, q2) = conquer(one, off[: m - 1]), conquer(two, off[m:])
    d, q = np.concatenate([d1, d2]), np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return _joined(d, np.concatenate([q1[-1], q2[0]]), rho, q) if rho else (d, q)


def symmetric(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    diagonal, off, q = tridiagonal(a / scale)
    off[np.abs(off) <= EPS * (np.abs(diagonal[1:]) + np.abs(diagonal[:-1])) / 4] = 0.0
    values, vectors = conquer(diagonal, off)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, (q @ vectors)[:, order]
