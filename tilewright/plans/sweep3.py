"""Cells of power diagrams in three dimensions, all facets of many cells at once.

A facet is a polygon in its own plane: a large square around the foot of the seed, cut by all other planes of the cell. So
the cutting of convex polygons in two dimensions serves here too, and integrals over a cell are those over its facets,
each the base of a pyramid with the seed at its top.
"""

from __future__ import annotations

import numpy as np

from .sweep import Polygons, Uniform

PER_BUCKET, PAIRS = 1.5, 100_000
#: So many planes cut first, then so many; what they leave says which of the others are near enough.
FEW = (16, 40)


class Grid3:
    """Seeds sorted by bucket of a cube of buckets."""

    def __init__(self, x: np.ndarray):
        self.lo, self.side = x.min(0), max(1, int((len(x) / PER_BUCKET) ** (1 / 3)))
        self.step = np.maximum((x.max(0) - self.lo) / self.side, 1e-300)
        key = self.bucket(x) @ [self.side**2, self.side, 1]
        self.order = np.argsort(key, kind="stable")
        self.start = np.searchsorted(key[self.order], np.arange(self.side**3 + 1))

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.lo) / self.step).astype(np.int64), 0, self.side - 1)

    def near(self, x: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, seed): all seeds in the rings around each x."""
        b = self.bucket(x)
        lo, hi = np.maximum(b[:, 2] - ring, 0), np.minimum(b[:, 2] + ring, self.side - 1)
        rows, seeds = [], []
        for d in np.ndindex(2 * ring + 1, 2 * ring + 1):
            at = b[:, :2] + d - ring
            ok = np.flatnonzero(((at >= 0) & (at < self.side)).all(1))
            line = (at[ok, 0] * self.side + at[ok, 1]) * self.side
            a, z = self.start[line + lo[ok]], self.start[line + hi[ok] + 1]
            n = z - a
            rows.append(np.repeat(ok, n))
            seeds.append(self.order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(rows), np.concatenate(seeds)

    def reach(self, x: np.ndarray, ring: int) -> np.ndarray:
        """Distance within which near() has every seed."""
        b = self.bucket(x)
        below = np.where(b <= ring, np.inf, x - (self.lo + (b - ring) * self.step))
        above = np.where(b + ring >= self.side - 1, np.inf, self.lo + (b + ring + 1) * self.step - x)
        return np.maximum(np.minimum(below, above).min(1), 0)


def bases(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two directions across each unit vector."""
    other = np.zeros_like(n)
    other[np.arange(len(n)), np.abs(n).argmin(1)] = 1
    first = np.cross(n, other)
    first /= np.linalg.norm(first, axis=1)[:, None]
    return first, np.cross(n, first)


class Facets:
    """The facets of cells with planes (cell, normal, away): n.(x - p) <= away, the nearest first in each cell."""

    def __init__(self, cell: np.ndarray, normal: np.ndarray, away: np.ndarray, size: float):
        self.cell, self.normal, self.away = cell, normal, away
        self.first, self.second = bases(normal)
        square = size * np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]])
        self.part = Polygons.of(square, np.full(4, -1), len(cell))
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        many = np.diff(np.append(start, len(cell)))
        begin, count = np.repeat(start, many), np.repeat(many, many)
        for j in range(int(many.max(initial=0))):
            row = np.flatnonzero((count > j) & (begin + j != np.arange(len(cell))) & (self.part.n > 0))
            by = begin[row] + j
            n = normal[by]
            flat = np.stack([(n * self.first[row]).sum(1), (n * self.second[row]).sum(1)], 1)
            cosine = (n * normal[row]).sum(1)
            offset = away[by] - away[row] * cosine
            # Of planes that coincide the first has the facet.
            twin = (cosine > 1 - 1e-14) & (np.abs(offset) <= 1e-13 * size)
            self.part.n[row[twin & (by < row)]] = 0
            self.part.cut(row[~twin], flat[~twin], offset[~twin], by[~twin])

    def radius(self, cells: int) -> np.ndarray:
        """How far each cell's furthest vertex is from its seed."""
        valid = np.arange(self.part.v.shape[1])[None] < self.part.n[:, None]
        far = np.where(valid, (self.part.v**2).sum(2) + self.away[:, None] ** 2, 0).max(1)
        out = np.zeros(cells)
        np.maximum.at(out, self.cell, far)
        return np.sqrt(out)


def _sorted(cell, normal, away, what):
    order = np.lexsort((away, cell))
    return cell[order], normal[order], away[order], what[order]


def sweep(x: np.ndarray, w: np.ndarray, mine: np.ndarray, box: np.ndarray, ids: np.ndarray, density: Uniform, grid: Grid3 | None = None) -> tuple[np.ndarray, tuple]:
    """As `sweep.local_sweep`: integrals [mass, s0, s1, s2, r2] of the cells mine, and (i, k, c, middle) of their facets."""
    if not isinstance(density, Uniform):
        raise NotImplementedError("in three dimensions the density is constant on a box")
    grid = grid or Grid3(x)
    moments, edges = np.zeros((len(mine), 5)), []
    size, heaviest = 4 * float(np.linalg.norm(box[1] - box[0]) + np.linalg.norm(np.ptp(np.concatenate([x, box]), 0))), float(w.max())
    walls = np.concatenate([-np.eye(3), np.eye(3)])
    offsets = np.concatenate([-box[0], box[1]])
    todo, ring = np.arange(len(mine)), 1
    while len(todo):
        again = []
        together = max(8, int(PAIRS / min((2 * ring + 1) ** 3 * PER_BUCKET, len(x)) / 8))
        for a in range(0, len(todo), together):
            some = todo[a : a + together]
            of, m = mine[some], len(some)
            p = x[of]
            row, seed = grid.near(p, ring)
            keep = seed != of[row]
            row, seed = row[keep], seed[keep]
            d = x[seed] - p[row]
            g = np.sqrt((d * d).sum(1))
            lost = np.unique(row[(g == 0) & ((w[seed] > w[of[row]]) | ((w[seed] == w[of[row]]) & (seed < of[row])))])
            row, seed, d, g = row[g > 0], seed[g > 0], d[g > 0], g[g > 0]
            away = (g + (w[of[row]] - w[seed]) / g) / 2
            own = np.repeat(np.arange(m), 6)
            cell, normal, away, what = _sorted(np.concatenate([own, row]), np.concatenate([np.tile(walls, (m, 1)), d / g[:, None]]), np.concatenate([np.tile(offsets, m) - (p[own] * np.tile(walls, (m, 1))).sum(1), away]), np.concatenate([np.tile(ids, m), seed]))
            for few in FEW:
                rank = np.arange(len(cell)) - np.searchsorted(cell, np.arange(m))[cell]
                first = (rank < few) | (what < 0)
                reach = Facets(cell[first], normal[first], away[first], size).radius(m)
                near = (away < reach[cell]) | first
                cell, normal, away, what = cell[near], normal[near], away[near], what[near]
            facets = Facets(cell, normal, away, size)
            r, room = facets.radius(m), grid.reach(p, ring)
            safe = np.isinf(room) | ((room > r) & ((room - r) ** 2 - heaviest >= r * r - w[of])) | (r == 0)
            safe[lost] = True
            again.append(some[~safe])
            flat = facets.part.moments()
            flat[np.isin(cell, lost) | ~safe[cell]] = 0
            area, across = flat[:, 0], flat[:, 1, None] * facets.first + flat[:, 2, None] * facets.second
            around = away[:, None] / 4 * (away[:, None] * area[:, None] * normal + across)
            total = np.stack([np.bincount(cell, c, m) for c in (away * area / 3, *around.T, away / 5 * (away**2 * area + flat[:, 3]))], 1)
            volume, s = total[:, 0], total[:, 1:4]
            done = np.concatenate([volume[:, None], s + p * volume[:, None], (total[:, 4] + 2 * (p * s).sum(1) + (p * p).sum(1) * volume)[:, None]], 1)
            moments[some[safe]] = done[safe]
            at = np.flatnonzero((area > 0) & (what >= 0))
            middle = p[cell[at]] + away[at, None] * normal[at] + across[at] / area[at, None]
            gap = np.linalg.norm(x[what[at]] - p[cell[at]], axis=1)
            edges.append((of[cell[at]], what[at], area[at] / (2 * gap), middle))
        todo, ring = np.concatenate(again), ring * 2
    i, k, c, middle = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 3)))
    return density.value * moments, (i, k, density.value * c, middle)
