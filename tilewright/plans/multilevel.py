"""Linear systems on neighbour graphs: conjugate gradients behind a hierarchy of ever coarser graphs.

Seeds in Morton order are joined four by four, which needs no look at the graph: neighbours in that order are neighbours in
space. Each level's graph is the sum of the finer one's edges; a cycle smooths, solves what is left on the coarser level
(twice, as constant blocks correct too little at once), and smooths again.
"""

from __future__ import annotations

import numpy as np

SMALLEST, SMOOTHING, TOGETHER, MORE = 200, 0.8, 4, 1.2


def morton(x: np.ndarray, bits: int = 15) -> np.ndarray:
    """Places in the order in which the coordinates' bits alternate."""
    lo, span = x.min(0), np.maximum(np.ptp(x, 0), 1e-300)
    cell = np.minimum((x - lo) / span * (1 << bits), (1 << bits) - 1).astype(np.uint64)
    key = np.zeros(len(x), np.uint64)
    for b in range(bits):
        for a in range(x.shape[1]):
            key |= (cell[:, a] >> np.uint64(b) & np.uint64(1)) << np.uint64(b * x.shape[1] + a)
    return np.argsort(key, kind="stable")


class Graph:
    """Edges (i, k, c) of a Laplacian, by row."""

    def __init__(self, n: int, i: np.ndarray, k: np.ndarray, c: np.ndarray):
        order = np.argsort(i, kind="stable")
        self.n, self.i, self.k, self.c = n, i[order], k[order], c[order]
        starts = np.searchsorted(self.i, np.arange(n))
        self.some = np.flatnonzero(np.append(starts[1:], len(i)) > starts)
        self.starts = starts[self.some]
        self.diagonal = np.bincount(i, c, n)
        self.live = self.diagonal > 0
        self.scale = 1 / np.where(self.live, self.diagonal, 1.0)

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.where(self.live, self.diagonal, 1.0) * x
        if len(self.some):
            out[self.some] -= np.add.reduceat(self.c * x[self.k], self.starts)
        return out

    def joined(self, to: np.ndarray, n: int) -> Graph:
        """The graph whose nodes are groups of these."""
        a, b = to[self.i], to[self.k]
        keep = a != b
        key, inverse = np.unique(a[keep] * n + b[keep], return_inverse=True)
        return Graph(n, key // n, key % n, np.bincount(inverse, self.c[keep], len(key)))


class Hierarchy:
    """Levels over a graph whose nodes are in an order of space."""

    def __init__(self, graph: Graph):
        self.levels, self.up, to = [graph], [], np.arange(graph.n) // TOGETHER
        while self.levels[-1].n > SMALLEST:
            n = int(to.max()) + 1
            self.up.append(to)
            self.levels.append(self.levels[-1].joined(to, n))
            to = np.arange(n) // TOGETHER
        last = self.levels[-1]
        full = np.diag(np.where(last.live, last.diagonal, 1.0))
        np.add.at(full, (last.i, last.k), -last.c)
        self.inverse = np.linalg.pinv(full, hermitian=True)

    def cycle(self, r: np.ndarray, level: int = 0) -> np.ndarray:
        graph = self.levels[level]
        if level == len(self.levels) - 1:
            return self.inverse @ r
        x = SMOOTHING * graph.scale * r
        to, coarse = self.up[level], self.levels[level + 1]
        rest = np.bincount(to, r - graph.times(x), coarse.n)
        e = self.cycle(rest, level + 1)
        if level + 2 < len(self.levels):
            e += self.cycle(rest - coarse.times(e), level + 1)
        x += MORE * e[to]
        return x + SMOOTHING * graph.scale * (r - graph.times(x))


def solve(n: int, i: np.ndarray, k: np.ndarray, c: np.ndarray, rhs: np.ndarray, x: np.ndarray, tol: float, most: int = 500) -> tuple[np.ndarray, int]:
    """v with sum_k c (v_i - v_k) = rhs_i, rhs less its mean, and the steps taken; rows without edges stay 0. x: positions."""
    order = morton(x)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    graph = Graph(n, place[i], place[k], c)
    levels = Hierarchy(graph)
    r = np.where(graph.live, (rhs - rhs.mean())[order], 0.0)
    v, goal = np.zeros(n), tol * np.sqrt(r @ r)
    p = z = levels.cycle(r)
    rz = r @ z
    for step in range(most):
        if np.sqrt(r @ r) <= goal:
            return v[place], step
        ap = graph.times(p)
        a = rz / (p @ ap)
        v, r = v + a * p, r - a * ap
        z = levels.cycle(r)
        new = r @ z
        p, rz = z + max(0.0, new / rz) * p, new
    return v[place], most
