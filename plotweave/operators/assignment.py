"""One-to-one assignment: of least cost on small dense matrices, of greatest gain on sparse pairs."""

from __future__ import annotations

import heapq

import numpy as np


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost; min(rows, columns) of them.

    Shortest augmenting paths with potentials, one column scan vectorised:
    O(rows^2 * columns). Ties between optimal solutions fall to the lower index.
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        reach, back, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = i, -1, 0.0
        tree = [i]
        while True:
            slack = base + cost[row] - u[row] - v
            better = ~seen & (slack < reach)
            reach[better], back[better] = slack[better], col
            col = int(np.argmin(np.where(seen, np.inf, reach)))
            base = reach[col]
            seen[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
            tree.append(row)
        for r in tree:
            at = np.flatnonzero(owner == r)
            u[r] += base - (reach[at[0]] if len(at) else 0.0)
        v[seen] += reach[seen] - base
        while col >= 0:
            prev = int(back[col])
            owner[col] = owner[prev] if prev >= 0 else i
            col = prev
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def sparse_assignment(left: np.ndarray, right: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Positions of the pairs of the one-to-one assignment with the greatest total gain; pairs without gain are never taken.

    Rows may stay alone at no gain, as if each had a partner of its own. Rows
    enter one by one, each along the shortest augmenting path of reduced costs:
    memory is that of the pairs, and a search ends at the first free partner.
    """
    n_left, n_right = int(left.max(initial=-1)) + 1, int(right.max(initial=-1)) + 1
    pairs: list[list[tuple[int, float, int]]] = [[] for _ in range(n_left)]
    for at, (i, j, w) in enumerate(zip(left.tolist(), right.tolist(), gain.tolist(), strict=True)):
        if w > 0:
            pairs[i].append((j, -w, at))
    for i in range(n_left):
        pairs[i].append((n_right + i, 0.0, -1))
    low = [min(c for _, c, _ in p) for p in pairs]
    high = [0.0] * (n_right + n_left)
    owner, mate = [-1] * (n_right + n_left), [(-1, -1)] * n_left
    for i in range(n_left):
        reach: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        seen: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base = i, 0.0
        while True:
            for j, c, at in pairs[row]:
                d = base + c - low[row] - high[j]
                if j not in seen and d < reach.get(j, np.inf):
                    reach[j], back[j] = d, (row, at)
                    heapq.heappush(heap, (d, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in seen and base == reach[j]:
                    break
            seen.add(j)
            if owner[j] < 0:
                break
            done.append(j)
            row = owner[j]
        low[i] += base
        for k in done:
            low[owner[k]] += base - reach[k]
            high[k] -= base - reach[k]
        while True:
            row, at = back[j]
            owner[j], (j, _), mate[row] = row, mate[row], (j, at)
            if row == i:
                break
    return np.array(sorted(at for _, at in mate if at >= 0), np.int64)
