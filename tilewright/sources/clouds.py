"""Point clouds and synthetic densities: text files, uniform and clustered generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_cloud(spark: SparkSession, path: str, d: int = 2) -> DataFrame:
    """(i, x0.., w) of a text cloud: comments after #, the number of points, then one line of coordinates and a weight
    for each. Raises if the number is wrong. Lines are parsed where they are; only the count is looked at here."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.split("value", "#")[0]).alias("line")).where("line <> ''")
    head = lines.orderBy("at").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    fields = F.split("line", r"\s+")
    rows = lines.where(F.col("at") > head["at"]).select("at", fields.alias("f"))
    wrong = rows.agg(F.count("*").alias("n"), F.sum((F.size("f") != d + 1).cast("int")).alias("odd")).first()
    if wrong["n"] != int(head["line"]) or wrong["odd"]:
        raise ValueError(f"{path} announces {head['line']} points of {d + 1} numbers and has {wrong['n']}, {wrong['odd']} of them of another length")
    # The high bits of a line's place are its partition, so a line's number is its place there after all earlier lines.
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["n"], r["first"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    before = np.cumsum([0, *(n for _, n, _ in sizes)])
    starts = spark.createDataFrame([(p, int(b)) for (p, *_), b in zip(sizes, before, strict=False)], "part long, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    rows = rows.withColumn("place", place).join(F.broadcast(starts), "part")  # a row for each part of the files
    return rows.select((F.col("before") + F.col("place")).cast("long").alias("i"), *[F.col("f")[a].cast("double").alias(f"x{a}") for a in range(d)], F.col("f")[d].cast("double").alias("w"))


def write_cloud(points: DataFrame, path: str, d: int = 2) -> None:
    """A text cloud in one file: its header has to come first."""
    n = points.count()
    body = points.select(F.col("i").alias("at"), F.concat_ws(" ", *[F.col(f"x{a}").cast("string") for a in range(d)], F.col("w").cast("string")).alias("value"))
    head = points.sparkSession.createDataFrame([(-2, "# points"), (-1, str(n))], "at long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


EDGE = 0.001
# Fixed values of the published cases: four bumps (centres, widths in sigmas, masses).
BUMPS = [(0.26, 0.30, 1.0, 0.35), (0.72, 0.26, 0.7, 0.25), (0.34, 0.74, 1.3, 0.25), (0.76, 0.70, 1.0, 0.15)]


def uniform_cloud(spark: SparkSession, n: int, d: int = 2, seed: int = 0, wscale: float = 0.0) -> DataFrame:
    """(i, x0.., w) in [.001, .999]^d, drawn on the executors; weights are uniform within wscale squared spacings."""
    x = [(F.rand(seed + 1_000_003 * (a + 1)) * (1 - 2 * EDGE) + EDGE).alias(f"x{a}") for a in range(d)]
    spacing = wscale * max(n, 1) ** (-2.0 / d)
    return spark.range(n).select(F.col("id").alias("i"), *x, ((2 * F.rand(seed + 1_000_003 * (d + 1)) - 1) * spacing).alias("w"))


def _scattered(spark: SparkSession, n: int, seed: int, shapes: list[tuple], weights: list[float], at, d: int) -> DataFrame:
    """Points of shapes (few, a row of numbers each) drawn by weight: at(shape, rand, randn) gives the coordinates."""
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(shapes)], "shape int, v array<double>")
    ends = np.cumsum(weights) / np.sum(weights)
    pick = sum(((F.col("u") >= float(e)).cast("int") for e in ends[:-1]), F.lit(0))
    draws = spark.range(n).select(F.col("id").alias("i"), F.rand(seed).alias("u"), F.rand(seed + 101).alias("s"), F.rand(seed + 202).alias("t"), F.randn(seed + 303).alias("e"))
    rows = draws.withColumn("shape", pick).join(F.broadcast(table), "shape")
    inside = lambda c: F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    return rows.select("i", *[inside(c).alias(f"x{a}") for a, c in enumerate(at(lambda k: F.col("v")[k]))], F.lit(0.0).alias("w"))


def lines_cloud(spark: SparkSession, n: int, seed: int = 0, chords: int = 5, sigma: float = 0.005, least: float = 0.7) -> DataFrame:
    """Points along chords from border to border of the unit square, at least so long, with a normal spread across them."""
    rng, shapes = np.random.default_rng(seed), []
    corner = lambda s: np.array([[s, 0.0], [1.0, s - 1], [3 - s, 1.0], [0.0, 4 - s]][min(int(s), 3)])
    while len(shapes) < chords:
        a, b = (corner(s) for s in rng.uniform(0, 4, 2))  # places along the border
        if (length := float(np.hypot(*(b - a)))) >= least:
            shapes.append((*a, *(b - a), *((b - a)[::-1] * (-1, 1) / length)))
    at = lambda v: [v(a) + F.col("t") * v(2 + a) + sigma * F.col("e") * v(4 + a) for a in range(2)]
    return _scattered(spark, n, seed, shapes, [np.hypot(s[2], s[3]) for s in shapes], at, 2)


def planes_cloud(spark: SparkSession, n: int, seed: int = 0, planes: int = 4, sigma: float = 0.02) -> DataFrame:
    """Points on planes that pass within a quarter of the unit cube's centre, as many on each, with a normal spread across.

    A plane's part in the cube is a convex polygon; a point is uniform in a triangle of its fan, taken by area.
    """
    rng, shapes, weights = np.random.default_rng(seed), [], []
    corners = np.array(np.meshgrid(*[[0.0, 1.0]] * 3)).reshape(3, -1).T
    edges = [(a, b) for a in corners for b in corners if (b > a).sum() == 1 and (b < a).sum() == 0]
    for _ in range(planes):
        u = rng.normal(size=3)
        u /= np.linalg.norm(u)
        off = u @ [0.5, 0.5, 0.5] + rng.uniform(-0.25, 0.25)
        cut = np.array([a + (off - u @ a) / (u @ (b - a)) * (b - a) for a, b in edges if (u @ a - off) * (u @ b - off) < 0])
        middle = cut.mean(0)
        first = (cut[0] - middle) / np.linalg.norm(cut[0] - middle)
        ring = cut[np.argsort(np.arctan2((cut - middle) @ np.cross(u, first), (cut - middle) @ first))]
        fan = [(ring[0], ring[k], ring[k + 1]) for k in range(1, len(ring) - 1)]
        area = np.array([np.linalg.norm(np.cross(b - a, c - a)) for a, b, c in fan])
        shapes += [(*a, *(b - a), *(c - a), *u) for a, b, c in fan]
        weights += list(area / area.sum())
    away, side = F.sqrt("s"), F.col("t")
    at = lambda v: [v(a) + away * ((1 - side) * v(3 + a) + side * v(6 + a)) + sigma * F.col("e") * v(9 + a) for a in range(3)]
    return _scattered(spark, n, seed, shapes, weights, at, 3)


def synthetic_image(spark: SparkSession, n: int, hole: bool = False) -> DataFrame:
    """(k0, k1, lo0, hi0, lo1, hi1, value): waves, a disk and a band over the unit square, n x n tiles; hole empties a square."""
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("k0"), (F.col("id") % n).cast("int").alias("k1"))
    x, y = (F.col("k0") + 0.5) / n, (F.col("k1") + 0.5) / n
    disk = (x - 0.30) * (x - 0.30) + (y - 0.70) * (y - 0.70) < 0.15**2
    value = 0.10 + 0.9 * F.pow(F.sin(3 * F.pi() * x) * F.cos(2 * F.pi() * y), F.lit(2)) + F.when(disk, 3.0).otherwise(0.0) + F.when(F.abs(x - y) < 0.02, 5.0).otherwise(0.0)
    empty = F.lit(hole) & (x > 0.62) & (x < 0.86) & (y > 0.10) & (y < 0.34)
    return grid.select("k0", "k1", (F.col("k0") / n).alias("lo0"), ((F.col("k0") + 1) / n).alias("hi0"), (F.col("k1") / n).alias("lo1"), ((F.col("k1") + 1) / n).alias("hi1"), F.when(empty, 0.0).otherwise(value).alias("value"))


def four_gaussians(spark: SparkSession, sigma: float = 0.02) -> DataFrame:
    """(g, c0, c1, sigma, mass): four bumps in the unit square."""
    return spark.createDataFrame([(k, x, y, sigma * s, m) for k, (x, y, s, m) in enumerate(BUMPS)], "g long, c0 double, c1 double, sigma double, mass double")
