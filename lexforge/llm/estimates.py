"""The Krichevsky-Trofimov estimate."""

from __future__ import annotations

import numpy as np

#: Counts below this come from a table.
TABLE = 1 << 14


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: eight steps up, then Stirling's series."""
    up = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        up[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


class KT:
    """log of the KT probability of n0 zeros and n1 ones, for arrays of whole counts."""

    def __init__(self):
        steps = np.arange(TABLE, dtype=float)
        self.half, self.whole = _lgamma(steps + 0.5), _lgamma(steps + 1)

    def _of(self, n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
        out = table[np.minimum(n, TABLE - 1)]
        large = n >= TABLE
        if large.any():
            out[large] = _lgamma(n[large] + shift)
        return out

    def log(self, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return self._of(n0, self.half, 0.5) + self._of(n1, self.half, 0.5) - self._of(n0 + n1, self.whole, 1.0) - np.log(np.pi)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return KT().log(np.asarray(n0, dtype=np.int64), np.asarray(n1, dtype=np.int64))
