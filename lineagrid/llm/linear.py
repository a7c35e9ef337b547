"""Small dense linear systems by elimination in plain numpy.

The threaded LAPACK routines of some numpy builds hang in a process that has
forked, as every Spark driver has when it starts its JVM. The systems here have
a few hundred rows, so elimination by array operations is fast enough.
"""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x`` with ``a @ x = b``; ``b`` is a vector or a matrix. Raises on a singular ``a``."""
    n = len(a)
    right = b.reshape(n, -1).astype(np.float64)
    both = np.concatenate([a.astype(np.float64), right], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        if both[pivot, k] == 0.0:
            raise np.linalg.LinAlgError("singular matrix")
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k, k:] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0.0
        used = np.flatnonzero(factor)
        both[used, k:] -= factor[used, None] * both[k, k:]
    return both[:, n:].reshape(b.shape)


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of ``a``. Raises on a singular ``a``."""
    return solve(a, np.eye(len(a)))
