"""Cutting stock by column generation, in numpy.

Items of a few integer sizes fill bins of one capacity. A linear program over
patterns (how many items of each size share a bin) is solved by the revised
simplex method; knapsack dynamic programming prices new patterns. Input and
output are bounded by the number of sizes, whatever the number of items.
"""

from __future__ import annotations

import numpy as np

from . import linear

_EPS = 1e-9


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack over ``sizes``."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    fits = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = best[c - sizes_up[:k]] + values_up[:k]
            j = int(total.argmax())
            if total[j] > best[c] + _EPS:
                best[c], choice[c] = total[j], j
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= sizes_up[choice[c]]
    return float(best[capacity]), pattern


def solve_patterns(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and fractional uses that cover ``demand`` with the fewest bins.

    Stops when no pattern prices below the duals, or after ``rounds`` pivots
    (default 40 a size): then the cover is still valid, only less tight.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.float64)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    for turn in range(rounds or 40 * m):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, np.maximum(duals, 0.0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        can = step > _EPS
        if not can.any():
            break
        ratio = np.full(m, np.inf)
        ratio[can] = np.maximum(amount[can], 0.0) / step[can]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if turn % 100 == 99:
            inverse = linear.inverse(basis)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        amount = inverse @ demand
    return basis.T.round().astype(np.int64), np.maximum(amount, 0.0)


def round_patterns(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, patterns: np.ndarray, uses: np.ndarray
) -> list[tuple[int, np.ndarray]]:
    """Whole uses of patterns that cover ``demand``: ``[(count, pattern), ...]``.

    Uses are rounded down; what is left goes first-fit in falling size into
    further bins. Slots never exceed the demand.
    """
    left = demand.astype(np.int64).copy()
    out: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-uses, kind="stable"):
        pattern = patterns[k]
        used = pattern > 0
        if used.any() and (n := min(int(np.floor(uses[k] + 1e-7)), int((left[used] // pattern[used]).min()))) > 0:
            out.append((n, pattern))
            left -= n * pattern
    bins: list[np.ndarray] = []
    room: list[int] = []
    for j in np.argsort(-sizes, kind="stable"):
        alone = int(capacity // sizes[j])
        if left[j] > 64 * alone:  # far more than rounding leaves: whole bins of one size
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[j] = alone
            out.append((int(left[j] // alone), pattern))
            left[j] %= alone
        for _ in range(int(left[j])):
            at = next((i for i, r in enumerate(room) if r >= sizes[j]), None)
            if at is None:
                bins.append(np.zeros(len(sizes), dtype=np.int64))
                room.append(capacity)
                at = len(room) - 1
            bins[at][j] += 1
            room[at] -= int(sizes[j])
    return out + [(1, b) for b in bins]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Pattern uses that place every item; empty when there are none."""
    if not len(sizes):
        return []
    patterns, uses = solve_patterns(sizes, demand.astype(np.float64), capacity)
    return round_patterns(sizes, demand, capacity, patterns, uses)
