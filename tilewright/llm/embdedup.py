"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are within the squared distance 2 - 2c. Rotated by one fixed orthogonal matrix and
split into BLOCKS blocks of coordinates, such a pair is within its proportional share of that budget in at least one
block. In each block a grid of side 2r over its first coordinates serves the range join: a vector lives in one cell and
visits the few later neighbour cells that the ball of radius r around it reaches. The grid takes one coordinate more for
each FINER times as many vectors, so that cells hold a falling share of the table. Vectors that meet are compared exactly,
in double precision; a pair counts only in the block in which it is closest, so it counts once. That block is found
alike in every task, for copies too.

Equal vectors of one label are one node, which counts as often as it comes, so a group of copies costs what one vector
does. Cells with more than TILE members are split into tiles and compared tile pair by tile pair; only link counts and a
forest of links leave a task, never the pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing;
vectors of any finite size are compared by direction; vectors of different lengths are never compared; equal vectors
link and tie, the smallest id stays; rows with the same vec_id are one vector, links between them do not count and those
of each row add up; a null vec_id links with nothing and has no component (null); other columns, whatever their names,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready
from .graph import components
from .words import mix

BLOCKS, GRID = 4, 4
#: So many times as many vectors as FEW let the grid take one coordinate more.
FINER, FEW = 4, 50_000
TILE = 4096
STEP = 1024


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]


def block_bounds(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    n = min(blocks, dim)
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def grid_for(rows: int) -> int:
    """Coordinates of a block that the grid takes."""
    grid = GRID
    while rows > FEW * FINER ** (grid - GRID + 1):
        grid += 1
    return grid


def visits(x: np.ndarray, threshold: float, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rotated unit vectors x: (row, block, cell, own) of the cells in which each lives or which it visits."""
    bounds = block_bounds(x.shape[1])
    budget = max(0.0, 2 - 2 * threshold) / len(bounds) * (1 + 1e-6) + 1e-12
    r = budget**0.5
    rows, blocks, cells, owns = [], [], [], []
    for b, (lo, hi) in enumerate(bounds):
        y = x[:, lo : min(hi, lo + grid)] / (2 * r)
        home = np.floor(y).astype(np.int64)
        gap = y - home  # 0 to 1; the nearer wall is at most r = 0.5 away
        side = np.where(gap < 0.5, -1, 1)
        away = (np.minimum(gap, 1 - gap) * 2 * r) ** 2
        at, cell, spent, differs = np.arange(len(x)), home.copy(), np.zeros(len(x)), np.zeros(len(x), bool)
        for k in range(y.shape[1]):  # coordinate by coordinate; of two neighbours, the one in the smaller cell visits
            cost = spent + away[at, k]
            go = np.flatnonzero((cost <= budget) & (differs | (side[at, k] > 0)))
            moved = cell[go]
            moved[:, k] += side[at[go], k]
            at, cell = np.concatenate([at, at[go]]), np.concatenate([cell, moved])
            spent, differs = np.concatenate([spent, cost[go]]), np.concatenate([differs, np.ones(len(go), bool)])
        rows.append(at)
        blocks.append(np.full(len(at), b))
        cells.append(mixed(cell))
        owns.append(~differs)
    return tuple(map(np.concatenate, (rows, blocks, cells, owns)))


def mixed(cell: np.ndarray) -> np.ndarray:
    """A name of each cell; that two should share one costs work alone."""
    out = np.zeros(len(cell), np.uint64)
    for column in cell.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out.view(np.int64)


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which of the rows are proper."""
    x = np.array([[np.nan if v is None else v for v in row] for row in vectors], np.float64)
    most = np.abs(x).max(1, initial=0) if x.size else np.zeros(len(x))
    fine = np.isfinite(most) & (most > 0)
    x = np.divide(x, most[:, None], out=np.full_like(x, np.nan), where=fine[:, None])  # no square overflows
    norm = np.sqrt((x * x).sum(1)) if x.size else np.zeros(len(x))
    good = np.isfinite(norm) & (norm > 0)
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=good[:, None]), good


def closest(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The block in which each pair of rows is closest, the same in every task; y = x @ rotation.

    The last bits of y depend on the other rows of the product. Pairs whose least two distances are within that error are
    decided by the rotated difference instead, summed in one fixed order: equal vectors are at 0 everywhere, in block 0.
    """
    dim = x.shape[1]
    bounds = block_bounds(dim)
    best, least, second = np.zeros(len(p), np.int64), np.full(len(p), np.inf), np.full(len(p), np.inf)
    for k, (lo, hi) in enumerate(bounds):
        d = y[p, lo:hi] - y[q, lo:hi]
        d = (d * d).sum(1)
        best, second = np.where(d < least, k, best), np.minimum(second, np.maximum(d, least))
        least = np.minimum(d, least)
    error = 2 * dim**1.5 * np.finfo(np.float64).eps
    unsure = np.flatnonzero(second - least <= 8 * error * (np.sqrt(np.minimum(second, 8)) + error))
    for a in range(0, len(unsure), STEP * 16):
        at = unsure[a : a + STEP * 16]
        apart = x[p[at]] - x[q[at]]
        differ = (apart != 0).any(1)
        best[at] = 0
        at, apart = at[differ], apart[differ].T.copy()
        if not len(at):
            continue
        least = np.full(len(at), np.inf)
        for k, (lo, hi) in enumerate(bounds):
            d = np.zeros(len(at))
            for column in rotation_of(dim)[:, lo:hi].T:
                turned = np.zeros(len(at))
                for c, row in zip(column, apart, strict=True):
                    turned += c * row
                d += turned * turned
            best[at], least = np.where(d < least, k, best[at]), np.minimum(d, least)
    return best


def compare(ids, raw, own, tile, pair, block: int, dim: int, threshold: float, times=None, rows=None):
    """(id, links, least id) of the linked members of a cell, for the tile pair (i, j).

    A member stands for as many vectors as times says to the others, and for as many rows as rows says to its own id.
    """
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    y = x @ rotation_of(dim)
    ids, own, tile = np.array(ids), np.array(own), np.array(tile)
    times, rows = (np.ones(len(ids)) if c is None else np.array(c) for c in (times, rows))
    label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    left, right = np.flatnonzero(tile == pair[0]), np.flatnonzero(tile == pair[1])
    for a in range(0, len(left), STEP):
        i = left[a : a + STEP]
        for b in range(0, len(right), STEP):
            j = right[b : b + STEP]
            hit = (x[i] @ x[j].T >= threshold) & (own[i][:, None] | own[j][None]) & (ids[i][:, None] != ids[j][None])
            if pair[0] == pair[1]:
                hit &= i[:, None] < j[None]
            p, q = np.nonzero(hit)
            if not len(p):
                continue
            p, q = i[p], j[q]
            mine = closest(x, y, p, q) == block
            p, q = p[mine], q[mine]
            count += np.bincount(p, times[q], len(ids)).astype(np.int64) + np.bincount(q, times[p], len(ids)).astype(np.int64)
            while len(p):  # labels sink to the least of each component
                low = np.minimum(label[p], label[q])
                before = label.copy()
                np.minimum.at(label, label[p], low)
                np.minimum.at(label, label[q], low)
                label = label[label]
                if (label == before).all():
                    break
    linked = np.flatnonzero(count)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return ids[linked], count[linked] * rows[linked].astype(np.int64), least[label[linked]]


_rotations: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = rotation(dim)
    return _rotations[dim]


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    proper = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)  # NaN is above all
    can = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & proper, F.lit(False))
    named = rows.select("vec_id", *(F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in (1, 2)), can.alias("can"))
    again = named.where("can").groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("vec_id").alias("twice"))
    named = materialize(named.join(again, F.col("can") & (F.col("vec_id") == F.col("twice")), "left"), "vector-names")
    nodes = named.where("can").groupBy("h1", "h2", "twice").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    nodes = materialize(nodes, "vector-nodes")
    first = rows.select("vec_id", "embedding", "label", *(F.xxhash64(F.lit(k), "label", "embedding").alias(f"g{k}") for k in (1, 2)))
    first = first.join(nodes, (F.col("vec_id") == F.col("id")) & (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")))
    first = first.groupBy("id", "h1", "h2").agg(*(F.first(c).alias(c) for c in ("times", "twice", "embedding", "label")))  # equal rows are one
    first = first.select("id", "times", F.when(F.col("twice").isNull(), 1).otherwise(F.col("times")).alias("rows"), "embedding", "label")
    grid = grid_for(nodes.count())

    def place(batches):
        for batch in batches:
            ids, times, each, vectors_, labels = (batch.column(k).to_pylist() for k in range(5))
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors_):
                by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                for a in range(0, len(at), 2000):
                    mine = at[a : a + 2000]
                    x, good = unit([vectors_[k] for k in mine])
                    mine, x = [k for k, g in zip(mine, good, strict=True) if g], x[good]
                    if not mine:
                        continue
                    row, block, cell, own = visits(x @ rotation_of(dim), threshold, grid)
                    raw, from_ = [v.tobytes() for v in x], [mine[k] for k in row.tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{labels[k]}/{dim}/{b}/{c}" for k, b, c in zip(from_, block.tolist(), cell.tolist(), strict=True)]),
                        *(pa.array([values[k] for k in from_], pa.int64()) for values in (ids, times, each)),
                        pa.array(own),
                        pa.array([raw[k] for k in row.tolist()], pa.binary()),
                    ], names=["cell", "id", "times", "rows", "own", "vector"])

    def join(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    out += _links(key, held, threshold)
                    key, held = row[0], []
                held.append(row)
            if out:
                yield _rows(out)
        if out := _links(key, held, threshold):
            yield _rows(out)

    placed = first.mapInArrow(place, "cell string, id long, times long, rows long, own boolean, vector binary")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("lived")).where("n > 1 and lived").select(F.col("cell").alias("of"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    members = placed.join(cells, F.col("cell") == F.col("of")).withColumn("tile", tile)
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.concat_ws("/", "cell", F.least("tile", "other"), F.greatest("tile", "other"))
    found = members.select(group.alias("key"), "id", "times", "rows", "own", "tile", "vector").repartition("key").sortWithinPartitions("key").mapInArrow(join, "id long, n long, to long")
    found = materialize(found, "vector-links")
    counts = found.groupBy(F.col("id").alias("i")).agg(F.sum("n").alias("n"))
    label = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    tied = nodes.join(counts, F.col("id") == F.col("i"), "left").join(label, F.col("id") == F.col("node"), "left")
    copies = F.when(F.col("twice").isNull(), F.col("times") - 1).otherwise(0)
    tied = tied.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("twice").alias("of"), (F.coalesce("n", F.lit(0)) + copies).alias("n"), F.coalesce("component", "id").alias("component"))
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("twice").eqNullSafe(F.col("of")) & F.col("can")
    out = named.join(tied, same, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _links(key, held, threshold: float):
    if len(held) < 2 or not any(r[4] for r in held):
        return []
    _, dim, block, _, i, j = key.rsplit("/", 5)
    _, ids, times, rows, own, tile, raw = zip(*held, strict=True)
    return list(zip(*(v.tolist() for v in compare(ids, raw, own, tile, (int(i), int(j)), int(block), int(dim), threshold, times, rows)), strict=True))


def _rows(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["id", "n", "to"])
