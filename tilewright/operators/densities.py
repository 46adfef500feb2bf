"""Densities integrated over cells, by more planes or by quadrature along facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import gauss_legendre
from .diagram import add_planes, facets2, measures2, moments, placed2, vertices

NODES = 32


def tile_planes(tiles: DataFrame) -> DataFrame:
    """(k0, k1, k, n0, n1, off): the four sides of each tile; k from -101 on."""
    side = lambda k, a, b, off: F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("n0"), F.lit(b).alias("n1"), off.alias("off"))
    return tiles.select("k0", "k1", F.inline(F.array(side(-101, -1.0, 0.0, -F.col("lo0")), side(-102, 1.0, 0.0, F.col("hi0")), side(-103, 0.0, -1.0, -F.col("lo1")), side(-104, 0.0, 1.0, F.col("hi1")))))


def cell_boxes(planes: DataFrame) -> DataFrame:
    """(id, lo0, hi0, lo1, hi1): a box around each cell; an open cell's has no end."""
    corner = vertices(facets2(planes, ["i"]), ["i"])
    far = F.lit(1e300)
    ends = [e for a in (0, 1) for e in (F.min(F.coalesce(f"x{a}", -far)).alias(f"lo{a}"), F.max(F.coalesce(f"x{a}", far)).alias(f"hi{a}"))]
    return corner.groupBy(F.col("i").alias("id")).agg(*ends)


def met(planes: DataFrame, boxes: DataFrame, of: list[str], cells: int = 16) -> DataFrame:
    """(i, of..): cells and pieces (of.., lo0, hi0, lo1, hi1) whose boxes overlap."""
    from .spatial import overlapping_pairs

    rows = overlapping_pairs(cell_boxes(planes), boxes.select(F.struct(*of).alias("id"), "lo0", "hi0", "lo1", "hi1"), cells)
    return rows.select(F.col("a").alias("i"), *[F.col(f"b.{c}").alias(c) for c in of])


def grid_pieces(planes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(i, k0, k1, mass, s0, s1, r2) of unit density: every piece that a tile cuts out of a cell."""
    keys = ["i", "k0", "k1"]
    cut = add_planes(planes, tile_planes(tiles), ["i"], ["k0", "k1"], met(planes, tiles, ["k0", "k1"]))
    return moments(measures2(placed2(facets2(cut, keys), None, keys), keys), keys)


def grid_moments(planes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(i, mass, s0, s1, r2) for a grid density."""
    rows = grid_pieces(planes, tiles).join(tiles.select("k0", "k1", "value"), ["k0", "k1"])
    return rows.groupBy("i").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in ("mass", "s0", "s1", "r2")])


def polytope_moments(planes: DataFrame, polytope: DataFrame, density: float) -> DataFrame:
    """(i, mass, s0, s1, r2) for a density that is constant on a convex polytope (k, n0, n1, off)."""
    walls = polytope.withColumn("piece", F.lit(0))
    keys = ["i", "piece"]
    cut = add_planes(planes, walls.select("piece", "k", "n0", "n1", "off"), ["i"], ["piece"])
    rows = moments(measures2(placed2(facets2(cut, keys), None, keys), keys), keys)
    return rows.select("i", *[(F.col(c) * density).alias(c) for c in ("mass", "s0", "s1", "r2")])


def triangle_table(nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """(e, x00.., volume, a, b0, b1): corners, signed-free area and the affine density a + b.x of each triangle; flat ones are dropped."""
    at = corners.join(nodes, "v")
    pick = lambda c, n: F.max(F.when(F.col("c") == c, F.col(n)))
    wide = at.groupBy("e").agg(*[pick(c, f"x{a}").alias(f"x{c}{a}") for c in range(3) for a in range(2)], *[pick(c, "value").alias(f"v{c}") for c in range(3)])
    u0, u1 = F.col("x10") - F.col("x00"), F.col("x11") - F.col("x01")
    w0, w1 = F.col("x20") - F.col("x00"), F.col("x21") - F.col("x01")
    det = u0 * w1 - u1 * w0
    wide = wide.withColumn("det", det).where("abs(det) > 1e-14")
    d1, d2 = F.col("v1") - F.col("v0"), F.col("v2") - F.col("v0")
    wide = wide.withColumn("b0", F.try_divide(d1 * w1 - d2 * u1, F.col("det"))).withColumn("b1", F.try_divide(d2 * u0 - d1 * w0, F.col("det")))
    return wide.withColumn("volume", F.abs("det") / 2).withColumn("a", F.col("v0") - F.col("b0") * F.col("x00") - F.col("b1") * F.col("x01"))


def triangle_walls(tri: DataFrame) -> DataFrame:
    """(e, k, n0, n1, off): the three sides of each triangle; k from -101 on."""
    sign = F.signum("det")

    def side(k: int, a: int, b: int):
        e0, e1 = F.col(f"x{b}0") - F.col(f"x{a}0"), F.col(f"x{b}1") - F.col(f"x{a}1")
        length = F.sqrt(e0 * e0 + e1 * e1)
        n0, n1 = sign * e1 / length, -sign * e0 / length
        return F.struct(F.lit(k).cast("long").alias("k"), n0.alias("n0"), n1.alias("n1"), (n0 * F.col(f"x{a}0") + n1 * F.col(f"x{a}1")).alias("off"))

    return tri.select("e", F.inline(F.array(side(-101, 0, 1), side(-102, 1, 2), side(-103, 2, 0))))


def facet_boxes(facets: DataFrame) -> DataFrame:
    """(id, lo0, hi0, lo1, hi1): a box around each bounded facet."""
    at = lambda t, a: F.col("off") * F.col(f"n{a}") + (-1 if a == 0 else 1) * F.col(t) * F.col(f"n{1 - a}")
    ends = [f(at("lo", a), at("hi", a)).alias(n) for a in (0, 1) for f, n in ((F.least, f"lo{a}"), (F.greatest, f"hi{a}"))]
    return facets.select(F.struct("i", "k").alias("id"), *ends)


def mesh_facet_masses(facets: DataFrame, nodes: DataFrame, corners: DataFrame, cells: int = 16) -> DataFrame:
    """(i, k, mass): the integral of a density that is affine on each triangle along each bounded facet between two seeds.

    A facet is clipped by the triangles that its box touches. One that lies along a side has the triangle on its inner side.
    """
    from .spatial import overlapping_pairs

    tri = triangle_table(nodes, corners)
    inner = facets.where("k >= 0")
    boxes = tri.select(F.col("e").alias("id"), *[f(*[f"x{c}{a}" for c in range(3)]).alias(n) for a in (0, 1) for f, n in ((F.least, f"lo{a}"), (F.greatest, f"hi{a}"))])
    met_ = overlapping_pairs(facet_boxes(inner), boxes, cells).select("a.i", "a.k", F.col("b").alias("e"))
    walls = triangle_walls(tri).select("e", F.col("n0").alias("h0"), F.col("n1").alias("h1"), F.col("off").alias("hoff"))
    c = F.col("h1") * F.col("n0") - F.col("h0") * F.col("n1")
    cosine = F.col("h0") * F.col("n0") + F.col("h1") * F.col("n1")
    rows = inner.join(met_, ["i", "k"]).join(walls, "e").withColumns({"c": c, "cosine": cosine, "r": F.col("hoff") - F.col("off") * cosine})
    along = F.abs("c") <= 1e-14
    clipped = rows.groupBy("i", "k", "e", "n0", "n1", "off", "lo", "hi").agg(
        F.max(F.when(F.col("c") < -1e-14, F.try_divide("r", "c"))).alias("from"),
        F.min(F.when(F.col("c") > 1e-14, F.try_divide("r", "c"))).alias("to"),
        F.min(F.when(along, F.when((F.abs("r") <= 1e-12) & (F.col("cosine") > 0), F.lit(1.0)).when(F.abs("r") <= 1e-12, F.lit(-1.0)).otherwise(F.col("r")))).alias("beside"),
    )
    a, b = F.greatest("lo", "from"), F.least("hi", "to")
    clipped = clipped.withColumns({"a": a, "b": b}).where("b > a and coalesce(beside, 1) > 0")
    middle = (F.col("a") + F.col("b")) / 2
    x0, x1 = F.col("off") * F.col("n0") - middle * F.col("n1"), F.col("off") * F.col("n1") + middle * F.col("n0")
    clipped = clipped.select("i", "k", "e", (F.col("b") - F.col("a")).alias("length"), x0.alias("m0"), x1.alias("m1")).join(tri.select("e", F.col("a").alias("f"), "b0", "b1"), "e")
    return clipped.groupBy("i", "k").agg(F.sum(F.col("length") * (F.col("f") + F.col("b0") * F.col("m0") + F.col("b1") * F.col("m1"))).alias("mass"))


def gaussian_facet_masses(facets: DataFrame, gaussians: DataFrame, n: int = NODES) -> DataFrame:
    """(i, k, mass): the integral of a mixture along each bounded facet between two seeds, at Gauss-Legendre nodes."""
    nodes = facets.sparkSession.createDataFrame(gauss_legendre(n), "u double, wt double")
    rows = facets.where("k >= 0").crossJoin(F.broadcast(nodes)).crossJoin(gaussians)
    t = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("u")
    d0, d1 = F.col("off") * F.col("n0") - t * F.col("n1") - F.col("c0"), F.col("off") * F.col("n1") + t * F.col("n0") - F.col("c1")
    s2 = F.col("sigma") * F.col("sigma")
    value = F.col("mass") * F.exp(-(d0 * d0 + d1 * d1) / (2 * s2)) / (2 * F.pi() * s2)
    return rows.groupBy("i", "k").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("wt") * value).alias("mass"))


def mesh_masses(planes: DataFrame, nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """(i, mass) for a density that is affine on each triangle."""
    tri = triangle_table(nodes, corners)
    walls = triangle_walls(tri)
    keys = ["i", "e"]
    boxes = tri.select("e", *[f(*[f"x{c}{a}" for c in range(3)]).alias(n) for a in (0, 1) for f, n in ((F.least, f"lo{a}"), (F.greatest, f"hi{a}"))])
    cut = add_planes(planes, walls, ["i"], ["e"], met(planes, boxes, ["e"]))
    rows = moments(measures2(placed2(facets2(cut, keys), None, keys), keys), keys)
    rows = rows.join(tri.select("e", "a", "b0", "b1"), "e")
    return rows.groupBy("i").agg(F.sum(F.col("a") * F.col("mass") + F.col("b0") * F.col("s0") + F.col("b1") * F.col("s1")).alias("mass"))


def gaussian_masses(facets: DataFrame, gaussians: DataFrame, n: int = NODES) -> DataFrame:
    """(i, mass) for a mixture of isotropic gaussians.

    Seen from a centre, a cell is the signed sum of the triangles to its facets; in polar angle the mass of one is the
    integral of 1 - exp(-h^2 / (2 s^2 cos^2)), taken at Gauss-Legendre nodes.
    """
    nodes = facets.sparkSession.createDataFrame(gauss_legendre(n), "u double, wt double")
    rows = facets.crossJoin(F.broadcast(gaussians))
    h = F.col("off") - F.col("n0") * F.col("c0") - F.col("n1") * F.col("c1")
    foot = F.col("n0") * F.col("c1") - F.col("n1") * F.col("c0")
    rows = rows.withColumn("h", h).where("abs(h) > 1e-14")
    size = F.abs("h")
    rows = rows.withColumns({"a0": F.atan(F.try_divide(F.col("lo") - foot, size)), "a1": F.atan(F.try_divide(F.col("hi") - foot, size))}).crossJoin(F.broadcast(nodes))
    cos = F.cos(F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("u"))
    inside = 1 - F.exp(-F.col("h") * F.col("h") / (2 * F.col("sigma") * F.col("sigma") * cos * cos))
    part = F.signum("h") * (F.col("a1") - F.col("a0")) * F.col("wt") * inside / (2 * F.pi())
    return rows.groupBy("i").agg(F.sum(F.col("mass") * part).alias("mass"))
