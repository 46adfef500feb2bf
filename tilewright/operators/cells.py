"""Convex cells as plane tables (cell, k, n0.., off), and conversion to vertices."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diagram import bounded, facets2, measures2, placed2, vertices

#: Ids of planes that are no seeds: the k-th domain plane is -1 - k.
SCHEMA = "cell long, k long, {}, off double"


def _table(spark: SparkSession, rows: list[tuple], d: int) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA.format(", ".join(f"n{a} double" for a in range(d))))


def hypercube(spark: SparkSession, d: int, origin: Sequence[float] | None = None, axes: Sequence[Sequence[float]] | None = None, cell: int = 0) -> DataFrame:
    """The parallelotope origin + sum of t_a axes_a with t in [0, 1]; the unit cube by default."""
    origin = np.zeros(d) if origin is None else np.asarray(origin, float)
    dual = np.linalg.inv(np.eye(d) if axes is None else np.asarray(axes, float))  # column a: t_a as a function of x
    rows = []
    for a in range(d):
        n = dual[:, a]
        size = np.linalg.norm(n)
        for s, t in ((-1.0, 0.0), (1.0, 1.0)):
            rows.append((cell, -1 - len(rows), *(float(s * x / size) for x in n), float(s * (n @ origin + t) / size)))
    return _table(spark, rows, d)


def unbounded(spark: SparkSession, d: int) -> DataFrame:
    """The whole space: no plane."""
    return _table(spark, [], d)


def cut(planes: DataFrame, direction: Sequence[float], offset: float, cut_id: int) -> DataFrame:
    """Every cell intersected with direction.x <= offset."""
    size = float(np.linalg.norm(direction))
    new = planes.select("cell").distinct().withColumn("k", F.lit(cut_id).cast("long"))
    for a, x in enumerate(direction):
        new = new.withColumn(f"n{a}", F.lit(float(x) / size))
    return planes.unionByName(new.withColumn("off", F.lit(float(offset) / size)))


def _facets(planes: DataFrame) -> DataFrame:
    return facets2(planes.withColumn("g", F.lit(None).cast("double")), ["cell"])


def measure(planes: DataFrame) -> DataFrame:
    """(cell, area) in the plane; empty cells have no row, those without bounds the largest double."""
    return measures2(placed2(_facets(planes), None, ["cell"]), ["cell"]).select("cell", "area")


def is_bounded(planes: DataFrame) -> DataFrame:
    return bounded(_facets(planes), ["cell"])


def corners(planes: DataFrame) -> DataFrame:
    return vertices(_facets(planes), ["cell"])


def interval(planes: DataFrame) -> DataFrame:
    """(cell, lo, hi, length) of one-dimensional cells; an end without plane is null."""
    hi = F.min(F.when(F.col("n0") > 0, F.col("off") / F.col("n0")))
    lo = F.max(F.when(F.col("n0") < 0, F.col("off") / F.col("n0")))
    return planes.groupBy("cell").agg(lo.alias("lo"), hi.alias("hi")).withColumn("length", F.greatest(F.lit(0.0), F.col("hi") - F.col("lo")))


def vertices_of(planes: DataFrame, d: int) -> DataFrame:
    """(cell, k0, k1[, k2], x0..): points where d planes of a cell meet and that all its planes allow, in two or three dimensions."""
    sides = []
    for s in range(d):
        sides.append(planes.select("cell", F.col("k").alias(f"k{s}"), *[F.col(f"n{a}").alias(f"n{s}{a}") for a in range(d)], F.col("off").alias(f"o{s}")))
    met = sides[0]
    for s in range(1, d):
        met = met.join(sides[s], "cell").where(F.col(f"k{s - 1}") < F.col(f"k{s}"))

    def det(columns: list[str]):
        """Of the matrix with these columns; columns are names like n{s}a or o{s}, s the row."""
        at = lambda s, c: F.col(c.replace("{s}", str(s)))
        if d == 2:
            return at(0, columns[0]) * at(1, columns[1]) - at(0, columns[1]) * at(1, columns[0])
        total = F.lit(0.0)
        for a in range(3):
            b, c = (a + 1) % 3, (a + 2) % 3
            total = total + at(0, columns[a]) * (at(1, columns[b]) * at(2, columns[c]) - at(1, columns[c]) * at(2, columns[b]))
        return total

    names = [f"n{{s}}{a}" for a in range(d)]
    met = met.withColumn("det", det(names)).where(F.abs("det") > 1e-12)
    for a in range(d):
        met = met.withColumn(f"x{a}", F.try_divide(det([*names[:a], "o{s}", *names[a + 1 :]]), F.col("det")))
    met = met.select("cell", *[f"k{s}" for s in range(d)], *[f"x{a}" for a in range(d)])
    inside = sum((F.col(f"n{a}") * F.col(f"x{a}") for a in range(d)), F.lit(0.0)) - F.col("off")
    walls = planes.select("cell", *[f"n{a}" for a in range(d)], "off")
    keys = ["cell", *[f"k{s}" for s in range(d)], *[f"x{a}" for a in range(d)]]
    return met.join(walls, "cell").groupBy(*keys).agg(F.max(inside).alias("most")).where("most <= 1e-9").drop("most")


def edges_of(planes: DataFrame) -> DataFrame:
    """(cell, a, b, n): pairs of planes of a 3D cell that share two vertices, with how many they share."""
    v = vertices_of(planes, 3)
    pairs = F.explode(F.array(*[F.struct(F.col(f"k{a}").alias("a"), F.col(f"k{b}").alias("b")) for a, b in combinations(range(3), 2)]))
    return v.withColumn("p", pairs).groupBy("cell", "p.a", "p.b").agg(F.count("*").alias("n")).where("n >= 2")


def faces_of(planes: DataFrame) -> DataFrame:
    """(cell, k, n): the planes of a 3D cell that carry vertices, with their number."""
    v = vertices_of(planes, 3)
    return v.withColumn("k", F.explode(F.array("k0", "k1", "k2"))).groupBy("cell", "k").agg(F.count("*").alias("n"))


def tightest_box(planes: DataFrame, d: int) -> DataFrame:
    """(cell, lo0, hi0, ..): the tightest bounds among the axis-aligned planes of each cell; null where there are none."""
    out = []
    for a in range(d):
        alone = F.lit(True)
        for b in range(d):
            if b != a:
                alone = alone & (F.col(f"n{b}") == 0)
        out += [F.max(F.when(alone & (F.col(f"n{a}") < 0), F.col("off") / F.col(f"n{a}"))).alias(f"lo{a}"), F.min(F.when(alone & (F.col(f"n{a}") > 0), F.col("off") / F.col(f"n{a}"))).alias(f"hi{a}")]
    return planes.groupBy("cell").agg(*out)


def blocks_of_cells(cells: DataFrame, blocks: DataFrame, grid: int = 16) -> DataFrame:
    """(cell, block, whole): blocks (id, lo0.., hi1) that meet the boxes of cells; whole where the cell's box lies inside."""
    from .spatial import overlapping_pairs

    pairs = overlapping_pairs(cells, blocks, grid).withColumnsRenamed({"a": "cell", "b": "block"})
    c = cells.select(F.col("id").alias("cell"), *[F.col(f"{e}{a}").alias(f"c{e}{a}") for a in (0, 1) for e in ("lo", "hi")])
    b = blocks.select(F.col("id").alias("block"), *[F.col(f"{e}{a}").alias(f"b{e}{a}") for a in (0, 1) for e in ("lo", "hi")])
    inside = (F.col("clo0") >= F.col("blo0")) & (F.col("chi0") <= F.col("bhi0")) & (F.col("clo1") >= F.col("blo1")) & (F.col("chi1") <= F.col("bhi1"))
    return pairs.join(c, "cell").join(b, "block").select("cell", "block", inside.alias("whole"))
