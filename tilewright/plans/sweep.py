"""All cells of a 2D power diagram at once, on arrays; and the same sweep as one Spark job.

Cells are padded polygons that are cut together, rank by rank, by their candidate neighbours in the order of
distance. Candidates come from rings of grid buckets; a cell is done when no seed beyond its ring, however heavy, can
reach its farthest vertex, else the ring grows for it alone. The result is exact.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seeds up to this number are sent to every executor (24 bytes each); the relational path serves larger diagrams.
MOST_SEEDS = 5_000_000
PER_BUCKET = 1.5
#: Cells cut together: their polygons fit the processor's cache.
TOGETHER = 4096
#: Pairs of a cell and a block that are looked at together.
FRONTIER = 50_000
#: Pairs of cell and candidate held at once.
PAIRS = 2_000_000
#: Pairs of cell and near seed that `neighbours` cuts at once; fuller buckets make for fewer cells.
NEAR = 500_000


@dataclass
class Polygons:
    """m convex polygons, counter-clockwise; edge k runs from vertex k to k + 1 and bears an id."""

    v: np.ndarray
    ids: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, ring: np.ndarray, ids: np.ndarray, m: int) -> Polygons:
        k = max(12, len(ring) + 4)
        v, e = np.zeros((m, k, 2)), np.full((m, k), -1, np.int64)
        v[:, : len(ring)], e[:, : len(ring)] = ring, ids
        return cls(v, e, np.full(m, len(ring)))

    def take(self, rows: np.ndarray) -> Polygons:
        return Polygons(self.v[rows], self.ids[rows], self.n[rows])

    def cut(self, rows: np.ndarray, normal: np.ndarray, offset: np.ndarray, ids: np.ndarray) -> None:
        """Keep of polygon rows[j] what satisfies normal[j].x <= offset[j]; the new edge bears ids[j]."""
        n = self.n[rows]
        valid = np.arange(self.v.shape[1])[None] < n[:, None]
        s = np.einsum("mkd,md->mk", self.v[rows], normal) - offset[:, None]
        out = (s > 0) & valid
        hit = out.any(1)
        gone = hit & ~((s <= 0) & valid).any(1)
        self.n[rows[gone]] = 0
        at = np.flatnonzero(hit & ~gone)
        if not len(at):
            return
        s, out, n, who = s[at], out[at], n[at], rows[at]
        k = self.v.shape[1]
        before = np.take_along_axis(out, (np.arange(k)[None] - 1) % n[:, None], 1)
        first = (~out & before & (np.arange(k)[None] < n[:, None])).argmax(1)
        turn = (first[:, None] + np.arange(k)[None]) % n[:, None]
        s, v, e = np.take_along_axis(s, turn, 1), np.take_along_axis(self.v[who], turn[..., None], 1), np.take_along_axis(self.ids[who], turn, 1)
        q = n - out.sum(1)  # vertices 0..q - 1 stay
        j = np.arange(len(at))
        a0, a1, b0 = q - 1, q % n, n - 1
        ta = (s[j, a0] / (s[j, a0] - s[j, a1]))[:, None]
        tb = (s[j, b0] / (s[j, b0] - s[j, 0]))[:, None]
        va, vb = v[j, a0] + ta * (v[j, a1] - v[j, a0]), v[j, b0] + tb * (v[j, 0] - v[j, b0])
        last = e[j, b0]
        if int(q.max()) + 2 > k:
            self._widen(int(q.max()) + 6)
            v, e = np.pad(v, ((0, 0), (0, self.v.shape[1] - k), (0, 0))), np.pad(e, ((0, 0), (0, self.v.shape[1] - k)), constant_values=-1)
        v[j, q], v[j, q + 1] = va, vb
        e[j, q], e[j, q + 1] = ids[at], last
        self.v[who], self.ids[who], self.n[who] = v, e, q + 2

    def _widen(self, k: int) -> None:
        more = k - self.v.shape[1]
        self.v = np.pad(self.v, ((0, 0), (0, more), (0, 0)))
        self.ids = np.pad(self.ids, ((0, 0), (0, more)), constant_values=-1)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(polygon, id, start, end) of all edges."""
        k = self.v.shape[1]
        valid = np.arange(k)[None] < self.n[:, None]
        row, at = np.nonzero(valid)
        after = np.where(at + 1 < self.n[row], at + 1, 0)
        return row, self.ids[row, at], self.v[row, at], self.v[row, after]

    def moments(self) -> np.ndarray:
        """[m, 4]: integrals of 1, x, y and |x|^2."""
        row, _, a, b = self.edges()
        m = len(self.n)
        base = np.zeros((m, 2))
        base[self.n > 0] = self.v[self.n > 0, 0]
        a, b = a - base[row], b - base[row]
        c = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        sum_ = lambda x: np.bincount(row, x, m)
        area = sum_(c / 2)
        sx, sy = sum_(c * (a[:, 0] + b[:, 0]) / 6), sum_(c * (a[:, 1] + b[:, 1]) / 6)
        q = sum_(c * ((a * a).sum(1) + (a * b).sum(1) + (b * b).sum(1)) / 12)
        r2 = q + 2 * (base[:, 0] * sx + base[:, 1] * sy) + (base**2).sum(1) * area
        return np.stack([area, sx + base[:, 0] * area, sy + base[:, 1] * area, r2], 1)


def box_ring(lo=(0.0, 0.0), hi=(1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a rectangle in turn and the planes between them; of a box the two ends, and its six planes."""
    if len(lo) == 3:
        return np.array([lo, hi], float), np.array([-1, -3, -5, -2, -4, -6])
    return np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]], float), np.array([-3, -2, -4, -1])


class Grid:
    """Seeds sorted by bucket."""

    def __init__(self, x: np.ndarray):
        self.lo, self.hi = x.min(0), x.max(0)
        self.side = max(1, int((len(x) / PER_BUCKET) ** 0.5))
        self.step = np.maximum((self.hi - self.lo) / self.side, 1e-300)
        b = self.bucket(x)
        key = b[:, 0] * self.side + b[:, 1]
        self.order = np.argsort(key, kind="stable")
        self.start = np.searchsorted(key[self.order], np.arange(self.side * self.side + 1))

    def tops(self, w: np.ndarray) -> list[np.ndarray]:
        """The largest weight in each bucket, then in blocks of 2 x 2 buckets, 4 x 4, .., up to one block."""
        full = self.start[:-1] < self.start[1:]
        side = 1 << (self.side - 1).bit_length()
        top = np.full(self.side * self.side, -np.inf)
        top[full] = np.maximum.reduceat(w[self.order], self.start[:-1][full])
        out = [np.full((side, side), -np.inf)]
        out[0][: self.side, : self.side] = top.reshape(self.side, self.side)
        while len(out[-1]) > 1:
            n = len(out[-1]) // 2
            out.append(out[-1].reshape(n, 2, n, 2).max((1, 3)))
        return out

    def open(self, tops: list[np.ndarray], part: Polygons, p: np.ndarray, pw: np.ndarray, ring: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket coordinates): buckets beyond the ring, and not beyond the ring upto, whose seeds may still cut a polygon.

        For one of its vertices v the least squared distance to the block less its largest weight is below |v - p|^2 - w.
        Blocks are opened from the largest down.
        """
        home = self.bucket(p)
        v = part.v[:, : int(part.n.max(initial=0))]
        corner = np.arange(v.shape[1])[None] < part.n[:, None]
        power = np.where(corner, ((v - p[:, None]) ** 2).sum(2) - pw[:, None], -np.inf)
        row = np.flatnonzero(part.n > 0)
        at = np.zeros((len(row), 2), np.int64)
        for level in range(len(tops) - 1, -1, -1):
            keep = np.empty(len(row), bool)
            for a in range(0, len(row), FRONTIER):
                r, b = row[a : a + FRONTIER], at[a : a + FRONTIER]
                lo, hi = self.lo + (b << level) * self.step, self.lo + np.minimum((b + 1) << level, self.side) * self.step
                away = np.maximum(np.maximum(lo[:, None] - v[r], v[r] - hi[:, None]), 0)
                keep[a : a + FRONTIER] = ((away**2).sum(2) - tops[level][b[:, 0], b[:, 1]][:, None] < power[r] - 1e-15).any(1)
            if upto is not None:
                first, last = home[row] - (at << level), ((at + 1) << level) - 1 - home[row]
                keep &= (np.maximum(-first, -last).max(1) <= upto) & (np.maximum(first, last).max(1) > ring)
            row, at = row[keep], at[keep]
            if level:
                row = np.repeat(row, 4)
                at = (2 * at[:, None] + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
                inside = (at << (level - 1) < self.side).all(1)
                row, at = row[inside], at[inside]
        far = np.abs(at - home[row]).max(1) > ring
        return row[far], at[far, 0], at[far, 1]

    def beyond(self, top: float, part: Polygons, p: np.ndarray, pw: np.ndarray, ring: int) -> np.ndarray:
        """Whether a seed beyond the ring, of the largest weight, might cut a polygon."""
        home, v = self.bucket(p), part.v[:, : int(part.n.max(initial=0))]
        a = np.where(home - ring > 0, self.lo + (home - ring) * self.step, -np.inf)
        z = np.where(home + ring < self.side - 1, self.lo + (home + ring + 1) * self.step, np.inf)
        free = np.maximum(np.minimum(v - a[:, None], z[:, None] - v).min(2), 0)
        cuts = free**2 - top < ((v - p[:, None]) ** 2).sum(2) - pw[:, None] - 1e-15
        return (cuts & (np.arange(v.shape[1])[None] < part.n[:, None])).any(1)

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.lo) / self.step).astype(np.int64), 0, self.side - 1)

    def many(self, x: np.ndarray, ring: int) -> np.ndarray:
        """How many seeds are in the rings around each x."""
        b, out = self.bucket(x), np.zeros(len(x), np.int64)
        lo, hi = np.maximum(b[:, 1] - ring, 0), np.minimum(b[:, 1] + ring, self.side - 1)
        for r in range(-ring, ring + 1):
            row = b[:, 0] + r
            ok = (row >= 0) & (row < self.side)
            out[ok] += self.start[row[ok] * self.side + hi[ok] + 1] - self.start[row[ok] * self.side + lo[ok]]
        return out

    def near(self, x: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, seed): all seeds in the rings around each x."""
        b = self.bucket(x)
        lo, hi = np.maximum(b[:, 1] - ring, 0), np.minimum(b[:, 1] + ring, self.side - 1)
        rows, seeds = [], []
        for d in range(-ring, ring + 1):
            r = b[:, 0] + d
            ok = np.flatnonzero((r >= 0) & (r < self.side))
            a, z = self.start[r[ok] * self.side + lo[ok]], self.start[r[ok] * self.side + hi[ok] + 1]
            m = z - a
            rows.append(np.repeat(ok, m))
            seeds.append(self.order[np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        return np.concatenate(rows), np.concatenate(seeds)


def cells(x: np.ndarray, w: np.ndarray, mine: np.ndarray, ring: np.ndarray, ids: np.ndarray, grid: Grid | None = None, reach: int = 2, tops: list[np.ndarray] | None = None, alone: bool = True, widening: bool = False) -> Polygons:
    """Polygons of the cells mine of the seeds (x, w) in the domain; only the seeds of the grid cut.

    The seeds of the rings around cut first. Their cells contain the true ones, so a bucket that cannot cut those cannot
    cut these; the seeds of the buckets that can are the rest. Of seeds at one place one has a cell; all have, if not alone.
    If widening, those buckets are taken in rings, each twice as far, and the cells are tested again after each.
    """
    grid = grid or Grid(x)
    tops = tops or grid.tops(w)
    if len(mine) > TOGETHER:
        parts = [cells(x, w, mine[a : a + TOGETHER], ring, ids, grid, reach, tops, alone, widening) for a in range(0, len(mine), TOGETHER)]
        widest = max(part.v.shape[1] for part in parts)
        for part in parts:
            part._widen(widest)
        return Polygons(*(np.concatenate([getattr(part, f) for part in parts]) for f in ("v", "ids", "n")))
    p, pw = x[mine], w[mine]
    part = Polygons.of(ring, ids, len(mine))
    _cut_by(part, x, w, mine, *grid.near(p, reach), alone)
    if not widening:
        _cut_open(part, x, w, mine, grid, alone, *grid.open(tops, part, p, pw, reach))
        return part
    top = float(tops[-1][0, 0])
    left = np.flatnonzero(grid.beyond(top, part, p, pw, reach))
    while len(left):  # what is near cuts first, so that little of what is far can
        row, b0, b1 = grid.open(tops, part.take(left), p[left], pw[left], reach, 2 * reach)
        _cut_open(part, x, w, mine, grid, alone, left[row], b0, b1)
        reach *= 2
        left = left[grid.beyond(top, part.take(left), p[left], pw[left], reach)]
    return part


def _cut_open(part: Polygons, x: np.ndarray, w: np.ndarray, mine: np.ndarray, grid: Grid, alone: bool, row: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
    """Cut the polygons row by the seeds of the buckets (b0, b1)."""
    bucket = b0 * grid.side + b1
    many = grid.start[bucket + 1] - grid.start[bucket]
    order = np.argsort(row, kind="stable")
    row, bucket, many = row[order], bucket[order], many[order]
    upto, a = np.cumsum(many), 0
    while a < len(row):  # whole cells, so many pairs at a time
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")), a + 1)
        b = int(np.searchsorted(row, row[b - 1], "right"))
        n = many[a:b]
        seed = grid.order[np.repeat(grid.start[bucket[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        _cut_by(part, x, w, mine, np.repeat(row[a:b], n), seed, alone)
        a = b


def _cut_by(part: Polygons, x: np.ndarray, w: np.ndarray, mine: np.ndarray, row: np.ndarray, seed: np.ndarray, alone: bool = True) -> None:
    """Cut the polygons row by the planes towards the seeds, the nearest first."""
    keep = (seed != mine[row]) & (part.n[row] > 0)
    row, seed = row[keep], seed[keep]
    if not len(row):
        return
    some, row = np.unique(row, return_inverse=True)
    of = mine[some]
    p, pw = x[of], w[of]
    d = x[seed] - p[row]
    g = np.sqrt((d * d).sum(1))
    # Of seeds at one place the heaviest, then the first, has the cell.
    same = g == 0
    lost = np.unique(row[alone & same & ((w[seed] > pw[row]) | ((w[seed] == pw[row]) & (seed < of[row])))])
    row, seed, d, g = row[~same], seed[~same], d[~same], g[~same]
    away = (g + (pw[row] - w[seed]) / g) / 2  # signed distance of the plane
    far = _radius(part, x[mine], some)
    near = away < far[row]
    row, seed, d, g, away = row[near], seed[near], d[near], g[near], away[near]
    order = np.lexsort((away, row))
    row, seed, d, g, away = row[order], seed[order], d[order], g[order], away[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
    by_rank = np.argsort(rank.astype(np.int32), kind="stable")
    ends = np.searchsorted(rank[by_rank], np.arange(int(rank.max(initial=-1)) + 2))
    for r in range(len(ends) - 1):
        at = by_rank[ends[r] : ends[r + 1]]
        at = at[away[at] < far[row[at]]]
        if not len(at):  # candidates come by distance: what is out of reach now stays so
            break
        n = d[at] / g[at, None]
        part.cut(some[row[at]], n, (n * p[row[at]]).sum(1) + away[at], seed[at])
        if r >= 5 and (r < 12 and r % 3 == 2 or r % 6 == 5):
            far = _radius(part, x[mine], some)
    part.n[some[lost]] = 0


def _radius(part: Polygons, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How far each polygon's furthest vertex is from its seed."""
    d = part.v[rows] - p[rows][:, None]
    return np.sqrt(np.where(np.arange(part.v.shape[1])[None] < part.n[rows][:, None], (d * d).sum(2), 0).max(1))


# --- densities: each yields per cell [mass, s0, s1, r2] and weights its facets ---
class Uniform:
    def __init__(self, value: float = 1.0):
        self.value = value

    def integrate(self, polygons: Polygons) -> tuple[np.ndarray, tuple]:
        row, ids, a, b = polygons.edges()
        inner = ids >= 0
        row, ids, a, b = row[inner], ids[inner], a[inner], b[inner]
        return self.value * polygons.moments(), (row, ids, self.value * np.linalg.norm(b - a, axis=1), (a + b) / 2)


class GridDensity:
    """Piecewise constant on a regular grid: values[k0, k1] over [lo, hi]; cells are cut along the tiles they touch."""

    def __init__(self, values, lo=(0.0, 0.0), hi=(1.0, 1.0)):
        self.values, self.lo, self.hi = np.asarray(values, float), np.asarray(lo, float), np.asarray(hi, float)
        self.step = (self.hi - self.lo) / self.values.shape

    def integrate(self, polygons: Polygons) -> tuple[np.ndarray, tuple]:
        m, valid = len(polygons.n), np.arange(polygons.v.shape[1])[None] < polygons.n[:, None]
        v = np.where(valid[..., None], polygons.v, np.nan)
        live = np.flatnonzero(polygons.n > 0)
        top = np.array(self.values.shape) - 1
        a = np.clip(((np.nanmin(v[live], 1) - self.lo) / self.step).astype(np.int64), 0, top)
        b = np.clip(((np.nanmax(v[live], 1) - self.lo) / self.step).astype(np.int64), 0, top)
        size = b - a + 1
        count = size.prod(1)
        own = np.repeat(live, count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        k = np.stack([np.repeat(a[:, 0], count) + nth // np.repeat(size[:, 1], count), np.repeat(a[:, 1], count) + nth % np.repeat(size[:, 1], count)], 1)
        value = self.values[k[:, 0], k[:, 1]]
        own, k, value = own[value > 0], k[value > 0], value[value > 0]
        pieces, rows = polygons.take(own), np.arange(len(own))
        for axis in (0, 1):
            for sign, wall in ((-1.0, self.lo[axis] + k[:, axis] * self.step[axis]), (1.0, self.lo[axis] + (k[:, axis] + 1) * self.step[axis])):
                normal = np.zeros((len(own), 2))
                normal[:, axis] = sign
                pieces.cut(rows, normal, sign * wall, np.full(len(own), -1001))
        mom = pieces.moments() * value[:, None]
        out = np.stack([np.bincount(own, mom[:, c], m) for c in range(4)], 1)
        row, ids, p, q = pieces.edges()
        inner = ids >= 0
        row, ids, p, q = row[inner], ids[inner], p[inner], q[inner]
        return out, (own[row], ids, value[row] * np.linalg.norm(q - p, axis=1), (p + q) / 2)


# A symmetric rule of degree 5 on a triangle (barycentric corner weight, node weight) and Gauss-Legendre nodes.
_DEGREE5 = [(1 / 3, 0.225), (0.0597158717897698, 0.1323941527885062), (0.7974269853530873, 0.1259391805448271)]
_LEG = [((float(a) + 1) / 2, float(b) / 2) for a, b in zip(*np.polynomial.legendre.leggauss(8), strict=True)]


class Pointwise:
    """Any density by value_at(points [n, 2]); fan triangles are split until they are smaller than size, then a degree 5 rule."""

    def __init__(self, value_at, size: float = 0.05, most: int = 6):
        self.value_at, self.size, self.most = value_at, size, most

    def integrate(self, polygons: Polygons) -> tuple[np.ndarray, tuple]:
        m = len(polygons.n)
        row, ids, a, b = polygons.edges()
        t = np.stack([polygons.v[row, 0], a, b], 1)
        own, out = row, np.zeros((m, 4))
        for level in range(self.most + 1):
            d = [t[:, i] - t[:, (i + 1) % 3] for i in range(3)]
            longest = np.sqrt(np.max([(x * x).sum(1) for x in d], 0))
            small = (longest <= self.size) | (level == self.most)
            _by_rule(out, own[small], t[small], self.value_at)
            t, own = t[~small], own[~small]
            if not len(t):
                break
            ab, bc, ca = (t[:, 0] + t[:, 1]) / 2, (t[:, 1] + t[:, 2]) / 2, (t[:, 2] + t[:, 0]) / 2
            t = np.concatenate([np.stack(x, 1) for x in ((t[:, 0], ab, ca), (ab, t[:, 1], bc), (ca, bc, t[:, 2]), (ab, bc, ca))])
            own = np.tile(own, 4)
        inner = ids >= 0
        row, ids, a, b = row[inner], ids[inner], a[inner], b[inner]
        line = sum(w * self.value_at(a + u * (b - a)) for u, w in _LEG)
        return out, (row, ids, line * np.linalg.norm(b - a, axis=1), (a + b) / 2)


def _by_rule(out: np.ndarray, own: np.ndarray, t: np.ndarray, value_at) -> None:
    """Add the integrals over triangles to their owners' [mass, s0, s1, r2]; exact up to degree 5."""
    area = _turn(t) / 2
    for corner, weight in _DEGREE5:
        for i in range(1 if corner == 1 / 3 else 3):
            other = (1 - corner) / 2
            bary = np.full(3, other)
            bary[i] = corner
            x = np.einsum("k,mkd->md", bary, t)
            f = weight * area * value_at(x)
            for c, g in enumerate((f, f * x[:, 0], f * x[:, 1], f * (x * x).sum(1))):
                out[:, c] += np.bincount(own, g, len(out))


class MeshDensity:
    """Affine on each triangle (corners [t, 3, 2], values [t, 3]); triangles are cut by the cells whose boxes they touch."""

    def __init__(self, corners, values):
        self.corners, self.values = np.asarray(corners, float), np.asarray(values, float)
        turned = _turn(self.corners) < 0
        self.corners[turned], self.values[turned] = self.corners[turned][:, ::-1], self.values[turned][:, ::-1]
        full = (_turn(self.corners) > 0) & (np.abs(self.values).max(1) > 0)
        self.corners, self.values = self.corners[full], self.values[full]
        self.low, self.high = self.corners.min(1), self.corners.max(1)
        # f(x) = value of the first corner + slope.(x - first corner)
        u, v = self.corners[:, 1] - self.corners[:, 0], self.corners[:, 2] - self.corners[:, 0]
        self.slope = np.linalg.solve(np.stack([u, v], 1), (self.values[:, 1:] - self.values[:, :1])[..., None])[..., 0]
        side = max(1, int((len(self.corners) / 2) ** 0.5))
        self.origin, self.side = self.low.min(0), side
        self.step = np.maximum((self.high.max(0) - self.origin) / side, 1e-300)
        triangle, bucket = self._spread(self.low, self.high)
        order = np.argsort(bucket, kind="stable")
        self.inside, self.start = triangle[order], np.searchsorted(bucket[order], np.arange(side * side + 1))

    def _spread(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, bucket): the buckets that each box touches."""
        a, b = (np.clip(((x - self.origin) / self.step).astype(np.int64), 0, self.side - 1) for x in (low, high))
        size = b - a + 1
        many = size.prod(1)
        own = np.repeat(np.arange(len(low)), many)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        return own, (a[own, 0] + nth // size[own, 1]) * self.side + a[own, 1] + nth % size[own, 1]

    def at(self, triangle: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.values[triangle, 0] + (self.slope[triangle] * (x - self.corners[triangle, 0])).sum(1)

    def integrate(self, polygons: Polygons) -> tuple[np.ndarray, tuple]:
        m, live = len(polygons.n), np.flatnonzero(polygons.n > 0)
        valid = (np.arange(polygons.v.shape[1])[None] < polygons.n[:, None])[live]
        v = np.where(valid[..., None], polygons.v[live], np.nan)
        low, high = np.nanmin(v, 1), np.nanmax(v, 1)
        own, bucket = self._spread(low, high)
        many = self.start[bucket + 1] - self.start[bucket]
        triangle = self.inside[np.repeat(self.start[bucket] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(np.repeat(own, many) * len(self.corners) + triangle)
        own, triangle = pair // len(self.corners), pair % len(self.corners)
        touch = ((low[own] <= self.high[triangle]) & (high[own] >= self.low[triangle])).all(1)
        own, triangle = live[own[touch]], triangle[touch]
        pieces, rows = polygons.take(own), np.arange(len(own))
        for a in range(3):
            p, q = self.corners[triangle, a], self.corners[triangle, (a + 1) % 3]
            normal = np.stack([q[:, 1] - p[:, 1], p[:, 0] - q[:, 0]], 1)
            pieces.cut(rows, normal, (normal * p).sum(1), np.full(len(own), -1001))
        row, ids, p, q = pieces.edges()
        out = np.zeros((m, 4))
        _by_rule(out, own[row], np.stack([pieces.v[row, 0], p, q], 1), lambda x: self.at(triangle[row], x))
        inner = ids >= 0
        row, ids, p, q = row[inner], ids[inner], p[inner], q[inner]
        middle = (p + q) / 2
        return out, (own[row], ids, self.at(triangle[row], middle) * np.linalg.norm(q - p, axis=1), middle)


def _turn(t: np.ndarray) -> np.ndarray:
    """Twice the signed areas of triangles."""
    u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    return u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]


class GaussianMixture(Pointwise):
    def __init__(self, centers, sigmas, masses):
        self.centers, self.sigmas, self.masses = np.asarray(centers, float), np.asarray(sigmas, float), np.asarray(masses, float)
        super().__init__(self._value, size=float(self.sigmas.min()) / 2, most=8)

    def _value(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for c, s, m in zip(self.centers, self.sigmas, self.masses, strict=True):
            d = x - c
            out += m * np.exp(-(d * d).sum(1) / (2 * s * s)) / (2 * np.pi * s * s)
        return out


@dataclass
class Sweep:
    """What one diagram gives: per seed its integrals, and the neighbour graph in coordinates."""

    moments: np.ndarray
    i: np.ndarray
    k: np.ndarray
    c: np.ndarray
    middle: np.ndarray = field(repr=False)


def local_sweep(x, w, mine, ring, ids, density, grid=None) -> tuple[np.ndarray, tuple]:
    polygons = cells(x, w, mine, ring, ids, grid)
    moments, (row, k, size, middle) = density.integrate(polygons)
    gap = np.linalg.norm(x[k] - x[mine[row]], axis=1)
    return moments, (mine[row], k, size / (2 * gap), middle)


def _solid(x: np.ndarray):
    from . import sweep3

    return sweep3.Grid3(x), sweep3.sweep


class Sweeper:
    """Diagrams of fixed positions for changing weights, one Spark job each; or on the driver without a session."""

    def __init__(self, x: np.ndarray, density, ring=None, ids=None, spark: SparkSession | None = None, tasks: int | None = None):
        if len(x) > MOST_SEEDS:
            raise ValueError(f"{len(x)} seeds are more than are sent to every executor; use operators.spatial.pruned_facets")
        self.x, self.density, self.spark = np.ascontiguousarray(x, float), density, spark
        self.ring, self.ids = (ring, ids) if ring is not None else box_ring()
        self.n_diagrams, self.last = 0, None
        self.grid, self.local = (Grid(self.x), local_sweep) if self.x.shape[1] == 2 else _solid(self.x)
        if spark is not None:
            self.tasks = tasks or max(1, min(spark.sparkContext.defaultParallelism, len(x) // 500))
            self.shared = spark.sparkContext.broadcast((self.x, self.grid, self.ring, self.ids, density))

    def __call__(self, w: np.ndarray) -> Sweep:
        if self.last is None or not np.array_equal(self.last[0], w):
            self.last = w.copy(), self._swept(w)
        return self.last[1]

    def _swept(self, w: np.ndarray) -> Sweep:
        self.n_diagrams += 1
        n = len(self.x)
        if self.spark is None or self.tasks == 1:
            moments, edges = self.local(self.x, w, np.arange(n), self.ring, self.ids, self.density, self.grid)
            return Sweep(moments, *edges)
        shared, weights, tasks, local, d = self.shared, self.spark.sparkContext.broadcast(w), self.tasks, self.local, self.x.shape[1]

        def run(batches):
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    x, grid, ring, ids, density = shared.value
                    mine = np.sort(grid.order[len(x) * t // tasks : len(x) * (t + 1) // tasks])
                    moments, (i, k, c, middle) = local(x, weights.value, mine, ring, ids, density, grid)
                    blobs = [mine.astype("<i8"), moments, i.astype("<i8"), k.astype("<i8"), c, middle]
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs], names=[f"b{j}" for j in range(6)])

        rows = self.spark.range(0, tasks, 1, tasks).mapInArrow(run, ", ".join(f"b{j} binary" for j in range(6))).toArrow().to_pylist()
        weights.unpersist()
        moments = np.zeros((n, d + 2))
        for r in rows:
            moments[np.frombuffer(r["b0"], "<i8")] = np.frombuffer(r["b1"]).reshape(-1, d + 2)
        cat = lambda j, t: np.concatenate([np.frombuffer(r[f"b{j}"], t) for r in rows])
        return Sweep(moments, cat(2, "<i8"), cat(3, "<i8"), cat(4, float), cat(5, float).reshape(-1, d))


def convex_ring(planes: np.ndarray) -> np.ndarray | None:
    """The corners in turn of what planes (n0, n1, off) leave of the plane; None where that is empty or has no end."""
    ring = []
    for j in np.argsort(np.arctan2(planes[:, 1], planes[:, 0]), kind="stable"):
        n, off = planes[j, :2], planes[j, 2]
        c, same = planes[:, 1] * n[0] - planes[:, 0] * n[1], planes[:, :2] @ n
        r, level = planes[:, 2] - off * same, np.abs(c) <= 1e-14
        lo, hi = (r[c < -1e-14] / c[c < -1e-14]).max(initial=-np.inf), (r[c > 1e-14] / c[c > 1e-14]).min(initial=np.inf)
        again = level & (np.abs(r) <= 1e-12) & (same > 0)
        if (level & (r < -1e-12)).any() or lo >= hi or again[:j].any():
            continue
        if np.isinf([lo, hi]).any():
            return None
        ring.append([off * n[0] - lo * n[1], off * n[1] + lo * n[0]])
    return np.array(ring) if len(ring) > 2 else None


def neighbours(seeds: DataFrame, ring: np.ndarray, tasks: int | None = None) -> DataFrame:
    """(i, k): the seeds k that bound the cell of i in the domain ring, and a row without k for each cell that is not empty.

    Seeds (i, x0, x1, w) at one place leave each other alone. The heaviest of them, then the last, cuts the other cells
    for all; those of one weight share a cell, which is cut once. Seeds without a place or weight have no row.
    """
    spark = seeds.sparkSession
    placed = F.lit(True)
    for c in ("x0", "x1", "w"):
        placed &= F.abs(c) < float("inf")
    t = seeds.where(placed).select(F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "w")]).toArrow()
    if len(t) > MOST_SEEDS:
        raise ValueError(f"{len(t)} seeds are more than are sent to every executor")
    if not len(t):
        return spark.createDataFrame([], "i long, k long")
    i, x0, x1, w = (t.column(j).to_numpy() for j in range(4))
    order = np.lexsort((i, w, x1, x0))
    i, x, w = i[order], np.stack([x0, x1], 1)[order] + 0.0, w[order]
    new_place = np.r_[True, (x[1:] != x[:-1]).any(1)]
    first = np.flatnonzero(new_place | np.r_[True, w[1:] != w[:-1]])  # of each cell
    last = np.r_[first[1:], len(i)] - 1
    cutting = np.r_[new_place[first[1:]], True]
    turn = np.argsort(~cutting, kind="stable")  # the cells of the seeds that cut come first
    first, last, n = first[turn], last[turn], int(cutting.sum())
    x, w = x[first], w[first]
    grid = Grid(x[:n])
    if tasks is None:
        tasks = max(1, min(max(4 * spark.sparkContext.defaultParallelism, len(x) // 20_000), len(x) // 500))
    _importable(spark)
    shared = spark.sparkContext.broadcast((i, x, w, first, last, grid, np.r_[grid.order, n : len(x)], ring))

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                i, x, w, first, last, grid, line, ring = shared.value
                tops, ids = grid.tops(w[: len(grid.order)]), -1 - np.arange(len(ring))
                mine = line[len(x) * t // tasks : len(x) * (t + 1) // tasks]
                upto, a = np.cumsum(grid.many(x[mine], 2)), 0
                while a < len(mine):
                    b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + NEAR, "right")), a + 1)
                    part = cells(x, w, mine[a:b], ring, ids, grid, 2, tops, alone=False, widening=True)
                    row, k, _, _ = part.edges()
                    row, k = np.unique(np.stack([row, np.maximum(k, -1)]), axis=1)  # -1: no seed
                    some = np.flatnonzero(part.n > 0)
                    row, k = np.r_[row[k >= 0], some], np.r_[k[k >= 0], np.full(len(some), -1)]
                    size = (last - first + 1)[mine[a:b]][row]
                    own = i[np.repeat(first[mine[a:b]][row] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    k = np.repeat(k, size)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(i[last[k]], mask=k < 0)], names=["i", "k"])
                    a = b

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, k long")


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed but run from a checkout."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
