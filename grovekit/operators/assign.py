"""Maximum-weight assignment between the rows and columns of a matrix, in NumPy."""

from __future__ import annotations

import numpy as np


def best_assignment(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, columns)`` of min(n, m) matched cells with the largest sum; cells may be negative.

    Shortest augmenting paths with potentials: O(n^2 m) for n <= m.  Ties may be matched in any way, the sum is the same.
    """
    w = np.asarray(weights, float)
    if w.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if w.shape[0] > w.shape[1]:
        c, r = best_assignment(w.T)
        order = np.argsort(r)
        return r[order], c[order]
    cost = w.max() - w
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        dist = np.full(m, np.inf)
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        row, col, reach = start, -1, 0.0
        while True:
            relaxed = reach + cost[row] - u[row] - v
            better = ~done & (relaxed < dist)
            dist[better] = relaxed[better]
            came[better] = col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reach = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[start] += reach
        mid = done & (row_of >= 0)
        u[row_of[mid]] += reach - dist[mid]
        v[done] -= reach - dist[done]
        while col >= 0:
            before = came[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    cols = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[cols])
    return row_of[cols][order], cols[order]


def best_sum(weights: np.ndarray) -> float:
    r, c = best_assignment(weights)
    return float(np.asarray(weights, float)[r, c].sum())
