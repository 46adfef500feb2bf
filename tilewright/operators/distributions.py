"""Distributions as tables: masses, normalisation, supports, pointwise values, spreading."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import running, with_total


# --- weighted points (batch?, i, x0.., w) ---
def dirac_mass(diracs: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """Weights summed per batch item; rows count where there is no weight column."""
    total = F.sum("w") if "w" in diracs.columns else F.count("*").cast("double")
    return diracs.groupBy(*batch).agg(total.alias("mass"))


def normalize_diracs(diracs: DataFrame, batch: list[str] = [], target: float = 1.0) -> DataFrame:  # noqa: B006
    weighed = diracs if "w" in diracs.columns else diracs.withColumn("w", F.lit(1.0))
    return with_total(weighed, "w", "__mass", batch).withColumn("w", F.col("w") * target / F.col("__mass")).drop("__mass")


def batch_slice(table: DataFrame, index) -> DataFrame:
    return table.where(F.col("batch").eqNullSafe(F.lit(index))).drop("batch")


# --- grids (k0.., lo0, hi0, .., value) with an optional frame ---
def tile_volume(d: int, det: float = 1.0):
    v = F.lit(abs(det))
    for a in range(d):
        v = v * (F.col(f"hi{a}") - F.col(f"lo{a}"))
    return v


def grid_table(spark: SparkSession, values, origin: Sequence[float] | None = None, knots: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Tiles of an array; origin is 0 and knots 0, 1, 2, .. where absent."""
    values = np.asarray(values, float)
    d = values.ndim
    origin = origin if origin is not None else [0.0] * d
    knots = knots if knots is not None else [list(range(n + 1)) for n in values.shape]
    rows = [tuple(int(x) for x in k) + tuple(float(origin[a] + knots[a][k[a] + b]) for a in range(d) for b in (0, 1)) + (float(values[k]),) for k in np.ndindex(*values.shape)]
    schema = ", ".join([*(f"k{a} int" for a in range(d)), *(f"{n}{a} double" for a in range(d) for n in ("lo", "hi")), "value double"])
    return spark.createDataFrame(rows, schema)


def box_table(spark: SparkSession, origin: Sequence[float], sides: Sequence[float], density: float = 1.0) -> DataFrame:
    """A grid of one tile."""
    return grid_table(spark, np.full([1] * len(sides), density), origin, [[0.0, s] for s in sides])


def grid_mass(tiles: DataFrame, d: int, det: float = 1.0) -> DataFrame:
    return tiles.agg(F.sum(F.col("value") * tile_volume(d, det)).alias("mass"))


def grid_mass_gradient(tiles: DataFrame, d: int, det: float = 1.0) -> DataFrame:
    """The mass by each value: the tile's volume."""
    return tiles.select(*[f"k{a}" for a in range(d)], tile_volume(d, det).alias("grad"))


def normalize_grid(tiles: DataFrame, d: int, target: float = 1.0) -> DataFrame:
    total = with_total(tiles, F.col("value") * tile_volume(d), "__mass")
    return total.withColumn("value", F.col("value") * target / F.col("__mass")).drop("__mass")


def cumulated(bins: DataFrame) -> DataFrame:
    """(k, before) in one dimension, and a last row with the total."""
    mass = F.col("value") * (F.col("hi") - F.col("lo"))
    rows = running(bins.select("k", mass.alias("mass")), "mass", ["k"], [], "before", "upto").select("k", "before")
    return rows.unionByName(bins.agg((F.max("k") + 1).alias("k"), F.sum(mass).alias("before")))


def bin_of(points: DataFrame, bins: DataFrame, x: str = "x") -> DataFrame:
    """points with the bin k that contains x, the first or last beyond the ends; bins are few and of any widths."""
    edges = F.broadcast(bins.agg(F.array_sort(F.collect_list(F.struct("lo", "k"))).alias("edges")))
    inside = F.filter("edges", lambda e: e["lo"] <= F.col(x))
    k = F.when(F.size(inside) > 0, F.element_at(inside, -1)["k"]).otherwise(F.element_at("edges", 1)["k"])
    return points.crossJoin(edges).withColumn("k", k).drop("edges")


def grid_support(tiles: DataFrame, d: int) -> DataFrame:
    """(k, n0.., off): the block as 2d half-spaces."""
    ends = tiles.agg(*[F.min(f"lo{a}").alias(f"lo{a}") for a in range(d)], *[F.max(f"hi{a}").alias(f"hi{a}") for a in range(d)])
    return ends.select(F.inline(F.array(*[F.struct(F.lit(-1 - 2 * a - s).cast("long").alias("k"), *[F.lit((1.0 if s else -1.0) if b == a else 0.0).alias(f"n{b}") for b in range(d)], (F.col(f"hi{a}") if s else -F.col(f"lo{a}")).alias("off")) for a in range(d) for s in (0, 1)])))


def blur(tiles: DataFrame, d: int, steps: Sequence[float], s: float) -> DataFrame:
    """Separable gaussian of width s, cut at four widths and renormalised at the border; steps are the tile sizes."""
    keys = [f"k{a}" for a in range(d)]
    out = tiles.select(*keys, "value")
    for a in range(d):
        width = s / steps[a]
        if width <= 1e-3:
            continue
        reach = int(np.ceil(4 * width))
        other = out.withColumnRenamed(keys[a], "j").withColumnRenamed("value", "v")
        near = out.drop("value").withColumn("j", F.explode(F.sequence(F.col(keys[a]) - reach, F.col(keys[a]) + reach)))
        rows = near.join(other, [*[k for k in keys if k != keys[a]], "j"])
        gap = (F.col("j") - F.col(keys[a])).cast("double")
        weight = F.exp(-0.5 * gap * gap / (width * width))
        out = rows.groupBy(*keys).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("value"))
    return out


def summed_area(tiles: DataFrame) -> DataFrame:
    """(k0, k1, upto): number of positive tiles at or before both indices, by two running sums."""
    along = tiles.withColumn("row", F.sum((F.col("value") > 0).cast("long")).over(Window.partitionBy("k0").orderBy("k1")))
    return along.select("k0", "k1", F.sum("row").over(Window.partitionBy("k1").orderBy("k0")).alias("upto"))


def box_counts(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(b, n): positive tiles in each box (b, a0, b0, a1, b1), ends included, from four corners of the summed areas."""
    table = summed_area(tiles)
    corner = lambda i, j, s: F.struct(i.alias("k0"), j.alias("k1"), F.lit(s).alias("s"))
    c = F.col
    corners = boxes.select("b", F.inline(F.array(corner(c("b0"), c("b1"), 1), corner(c("a0") - 1, c("b1"), -1), corner(c("b0"), c("a1") - 1, -1), corner(c("a0") - 1, c("a1") - 1, 1))))
    return corners.join(table, ["k0", "k1"], "left").groupBy("b").agg(F.sum(F.col("s") * F.coalesce("upto", F.lit(0))).alias("n"))


def display_blocks(tiles: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(k0, a1, b1): runs of neighbouring tiles above threshold times the largest value, along the last axis."""
    most = tiles.agg(F.max("value").alias("most"))
    kept = tiles.crossJoin(F.broadcast(most)).where(F.col("value") > threshold * F.col("most"))
    order = Window.partitionBy("k0").orderBy("k1")
    start = (F.col("k1") != F.lag("k1", 1, -2).over(order) + 1).cast("int")
    runs = kept.withColumn("start", start).withColumn("run", F.sum("start").over(order))
    return runs.groupBy("k0", "run").agg(F.min("k1").alias("a1"), F.max("k1").alias("b1")).drop("run")


def merged_blocks(tiles: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a0, b0, a1, b1): display_blocks, equal runs of neighbouring rows merged."""
    rows = display_blocks(tiles, threshold)
    order = Window.partitionBy("a1", "b1").orderBy("k0")
    start = (F.col("k0") != F.lag("k0", 1, -2).over(order) + 1).cast("int")
    runs = rows.withColumn("start", start).withColumn("run", F.sum("start").over(order))
    return runs.groupBy("a1", "b1", "run").agg(F.min("k0").alias("a0"), F.max("k0").alias("b0")).select("a0", "b0", "a1", "b1")


# --- mixtures of isotropic gaussians (g, c0, c1, sigma, mass) ---
def normalize_gaussians(g: DataFrame, target: float = 1.0) -> DataFrame:
    return with_total(g, "mass", "__all").withColumn("mass", F.col("mass") * target / F.col("__all")).drop("__all")


def convolve_gaussians(g: DataFrame, s: float) -> DataFrame:
    return g.withColumn("sigma", F.sqrt(F.col("sigma") * F.col("sigma") + F.lit(s * s)))


def gaussian_support(g: DataFrame, sigmas: float = 6.0) -> DataFrame:
    r = F.lit(sigmas) * F.col("sigma")
    return g.agg(*[e.alias(n) for a in range(2) for n, e in ((f"lo{a}", F.min(F.col(f"c{a}") - r)), (f"hi{a}", F.max(F.col(f"c{a}") + r)))])


def _bumps(points: DataFrame, g: DataFrame) -> DataFrame:
    """Points by gaussians: the mixture is the small side."""
    d0, d1 = F.col("x0") - F.col("c0"), F.col("x1") - F.col("c1")
    s2 = F.col("sigma") * F.col("sigma")
    rows = points.crossJoin(F.broadcast(g)).withColumns({"d0": d0, "d1": d1, "s2": s2})
    return rows.withColumn("phi", F.exp(-(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1")) / (2 * F.col("s2"))) / (2 * F.pi() * F.col("s2")))


def gaussian_values(points: DataFrame, g: DataFrame) -> DataFrame:
    """(q, value, grad0, grad1)."""
    wphi = F.col("mass") * F.col("phi")
    return _bumps(points, g).groupBy("q").agg(F.sum(wphi).alias("value"), F.sum(-wphi * F.col("d0") / F.col("s2")).alias("grad0"), F.sum(-wphi * F.col("d1") / F.col("s2")).alias("grad1"))


def gaussian_parameter_gradients(points: DataFrame, g: DataFrame) -> DataFrame:
    """(g, by_mass, by_c0, by_c1, by_sigma): the sum over points of the value, by each parameter."""
    wphi = F.col("mass") * F.col("phi")
    r2 = F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1")
    return _bumps(points, g).groupBy("g").agg(F.sum("phi").alias("by_mass"), F.sum(wphi * F.col("d0") / F.col("s2")).alias("by_c0"), F.sum(wphi * F.col("d1") / F.col("s2")).alias("by_c1"), F.sum(wphi * (r2 / F.col("s2") - 2) / F.col("sigma")).alias("by_sigma"))


# --- meshes: nodes (v, x0, x1), corners (e, c, v, value) ---
def mesh_mass(triangles: DataFrame) -> DataFrame:
    return triangles.agg(F.sum(F.col("volume") * (F.col("v0") + F.col("v1") + F.col("v2")) / 3).alias("mass"))


def mesh_support(nodes: DataFrame, margin: float = 0.1) -> DataFrame:
    ends = []
    for a in range(2):
        lo, hi = F.min(f"x{a}"), F.max(f"x{a}")
        ends += [(lo - margin * (hi - lo)).alias(f"lo{a}"), (hi + margin * (hi - lo)).alias(f"hi{a}")]
    return nodes.agg(*ends)


def corner_step(corners: DataFrame, volumes: DataFrame, d: int = 2) -> DataFrame:
    """One spreading step: corners take their simplex's mean, then each node the mean of its corners weighted by volume."""
    means = corners.groupBy("e").agg(F.avg("value").alias("mean"))
    rows = corners.select("e", "c", "v").join(means, "e").join(volumes.select("e", "volume"), "e")
    nodal = rows.groupBy("v").agg((F.sum(F.col("mean") * F.col("volume") / (d + 1)) / F.sum(F.col("volume") / (d + 1))).alias("value"))
    return corners.select("e", "c", "v").join(nodal, "v").select("e", "c", "v", "value")


def corner_averages(corners: DataFrame, volumes: DataFrame, k: float, method: str = "iter", eps: float = 1e-8) -> DataFrame:
    """The spread state k: below 1 a mix with one step, then k - 1 more steps (a fraction is linear), or, with "cheb",
    exp(-(k - 1)(I - W)) by its Chebyshev series. Lineage is cut after each step in the shared checkpoint folder."""
    first = corner_step(corners, volumes)
    if k <= 1:
        mixed = corners.join(first.select("e", "c", F.col("value").alias("one")), ["e", "c"])
        return mixed.select("e", "c", "v", ((1 - k) * F.col("value") + k * F.col("one")).alias("value"))
    step = lambda x: _cut(corner_step(x, volumes))
    t = k - 1
    state = _cut(first)
    if method == "iter":
        for _ in range(int(t)):
            state = step(state)
        part = t - int(t)
        return state if part < 1e-12 else _combine([(1 - part, state), (part, step(state))])
    if method != "cheb":
        raise ValueError(f"unknown method: {method!r}")
    bessel = scaled_bessel(t / 2, eps)
    before, now, terms = None, state, [(bessel[0], state)]
    for j in range(1, len(bessel)):  # T_j of I - 2 W
        image = _combine([(1.0, now), (-2.0, step(now))])
        after = image if before is None else _combine([(2.0, image), (-1.0, before)])
        before, now = now, _cut(after)
        terms.append((2 * (-1) ** j * bessel[j], now))
    return _combine(terms)


def scaled_bessel(z: float, eps: float) -> list[float]:
    """exp(-z) I_j(z), downward from where they vanish, scaled so that the series of exp sums to 1; down to eps."""
    n = int(z + 20 * np.sqrt(z + 1) + 30)
    x = np.zeros(n + 2)
    x[n] = 1e-300
    for j in range(n, 0, -1):
        x[j - 1] = x[j + 1] + (2 * j / max(z, 1e-300)) * x[j]
        if x[j - 1] > 1e250:
            x /= x[j - 1]
    x /= x[0] + 2 * x[1:].sum()
    keep = max(1, int(np.flatnonzero(x >= eps).max(initial=0)) + 1)
    return x[:keep].tolist()


def _combine(terms: list[tuple[float, DataFrame]]) -> DataFrame:
    out = None
    for a, df in terms:
        part = df.select("e", "c", "v", (F.lit(a) * F.col("value")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("e", "c", "v").agg(F.sum("value").alias("value"))


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the folder that all machines share."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tilewright-"))
    return df.checkpoint()


def spread_start(corners: DataFrame, volumes: DataFrame, flatness: float = 3.0, most: int = 1 << 22) -> int:
    """The first power of two whose spread density is nowhere above flatness times its mean."""
    k = 1
    while k < most:
        rows = corner_averages(corners, volumes, k, "cheb").join(volumes.select("e", "volume"), "e")
        r = rows.agg(F.max("value").alias("most"), (F.sum(F.col("value") * F.col("volume")) / F.sum("volume")).alias("mean")).first()
        if r["most"] <= flatness * r["mean"]:
            return k
        k *= 2
    return k


def hull(points: Sequence[Sequence[float]]) -> np.ndarray:
    """Counter-clockwise hull of a few points in the plane; raises if a point lies strictly inside."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        raise ValueError("a polygon needs three points")

    def chain(p):
        out: list = []
        for x in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    ring = np.array(chain(pts.tolist()) + chain(pts.tolist()[::-1]))
    if len(ring) < len(pts):
        raise ValueError("the polygon is not convex")
    return ring


def polygon_planes(spark: SparkSession, points: Sequence[Sequence[float]]) -> DataFrame:
    """(k, n0, n1, off) of a convex polygon."""
    ring = hull(points)
    e = np.roll(ring, -1, 0) - ring
    n = np.stack([e[:, 1], -e[:, 0]], 1) / np.linalg.norm(e, axis=1)[:, None]
    return spark.createDataFrame([(-1 - k, float(a), float(b), float(a * p + b * q)) for k, ((a, b), (p, q)) in enumerate(zip(n, ring, strict=True))], "k long, n0 double, n1 double, off double")


def normalized_planes(planes: DataFrame, d: int) -> DataFrame:
    size = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in range(d)), F.lit(0.0)))
    return planes.select("k", *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in range(d)], (F.col("off") / size).alias("off"))


def largest_cube(normals, offsets) -> tuple[np.ndarray, float]:
    """Centre and half side of a largest axis-aligned cube in a small polytope n.x <= off: maximise r with n.c + r |n|_1 <= off.

    The optimum is at a vertex of these constraints in (c, r); they are few, so all are tried.
    """
    from itertools import combinations

    n, off = np.asarray(normals, float), np.asarray(offsets, float)
    a = np.concatenate([n, np.abs(n).sum(1)[:, None]], 1)
    best, where = -1.0, None
    for rows in combinations(range(len(a)), a.shape[1]):
        m = a[list(rows)]
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        x = np.linalg.solve(m, off[list(rows)])
        if x[-1] > best and (a @ x <= off + 1e-9).all():
            best, where = x[-1], x[:-1]
    if where is None:
        raise ValueError("the polytope is empty or without bounds")
    return where, float(best)
