"""Candidate generation: buckets, majorants, overlapping boxes, duplicates, and exact pruning of diagrams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import running
from .diagram import bisectors, cell_planes, facets2, vertices


def bucketed(seeds: DataFrame, cells: int) -> DataFrame:
    """seeds with the grid cell (b0, b1) of a cells x cells grid over the unit square."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    return seeds.withColumn("b0", at("x0")).withColumn("b1", at("x1"))


def majorants(seeds: DataFrame, cells: int) -> DataFrame:
    """(b0, b1, n, lo0, hi0, lo1, hi1, top): each bucket's box and largest weight."""
    return bucketed(seeds, cells).groupBy("b0", "b1").agg(F.count("*").alias("n"), F.min("x0").alias("lo0"), F.max("x0").alias("hi0"), F.min("x1").alias("lo1"), F.max("x1").alias("hi1"), F.max("w").alias("top"))


def ranks(seeds: DataFrame, cells: int) -> DataFrame:
    """(i, rank): places in bucket order."""
    in_bucket = Window.partitionBy("b0", "b1").orderBy("i")
    sizes = majorants(seeds, cells).select("b0", "b1", F.col("n").cast("double").alias("n"))
    sizes = running(sizes, "n", ["b0", "b1"], [], "before", "upto")
    rows = bucketed(seeds, cells).withColumn("at", F.row_number().over(in_bucket) - 1).join(sizes, ["b0", "b1"])
    return rows.select("i", (F.col("before") + F.col("at")).cast("long").alias("rank"))


def duplicates(seeds: DataFrame, d: int = 2) -> DataFrame:
    """(dup, rep): seeds at the position of one with a smaller index."""
    rep = F.min("i").over(Window.partitionBy(*[f"x{a}" for a in range(d)]))
    return seeds.withColumn("rep", rep).where("i <> rep").select(F.col("i").alias("dup"), "rep")


def overlapping_pairs(a: DataFrame, b: DataFrame, cells: int = 8) -> DataFrame:
    """(a, b): boxes (id, lo0, hi0, lo1, hi1) that overlap, met in the grid cells that they touch; each pair is kept in
    the cell of the larger of the two lower corners, so none comes twice."""
    def spread(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col("id").alias(name), *[F.col(f"{e}{x}").alias(f"{name}{e}{x}") for x in (0, 1) for e in ("lo", "hi")])
        for x in (0, 1):
            first, last = (F.least(F.greatest(F.floor(F.col(f"{name}{e}{x}") * cells), F.lit(0)), F.lit(cells - 1)).cast("int") for e in ("lo", "hi"))
            df = df.withColumn(f"g{x}", F.explode(F.sequence(first, last)))
        return df

    met = spread(a, "a").join(spread(b, "b"), ["g0", "g1"])
    for x in (0, 1):
        corner = F.least(F.greatest(F.floor(F.greatest(f"alo{x}", f"blo{x}") * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
        met = met.where((F.col(f"alo{x}") <= F.col(f"bhi{x}")) & (F.col(f"blo{x}") <= F.col(f"ahi{x}")) & (F.col(f"g{x}") == corner))
    return met.select("a", "b")


def ring_pairs(seeds: DataFrame, cells: int, ring: int = 1) -> DataFrame:
    """(i, k): seeds in buckets at most ring apart."""
    rows = bucketed(seeds, cells).select("i", "b0", "b1")
    near = rows
    for x in ("b0", "b1"):
        near = near.withColumn(x, F.explode(F.sequence(F.col(x) - ring, F.col(x) + ring)))
    return near.join(rows.withColumnRenamed("i", "k"), ["b0", "b1"]).where("i <> k").select("i", "k")


def open_buckets(seeds: DataFrame, facets: DataFrame, cells: int, ring: int) -> DataFrame:
    """(i, b0, b1): buckets beyond the ring that may still cut cell i: for one of its vertices v, the least squared
    distance to the bucket's box less its largest weight is below |v - p|^2 - w. A vertex meets the buckets within the
    reach that the largest of all weights leaves it."""
    boxes, top = majorants(seeds, cells), seeds.agg(F.max("w")).first()[0] or 0.0
    v = vertices(facets, ["i"]).select("i", F.col("x0").alias("v0"), F.col("x1").alias("v1"))
    v = v.join(bucketed(seeds, cells).select("i", "x0", "x1", "w", F.col("b0").alias("h0"), F.col("b1").alias("h1")), "i")
    power = (F.col("v0") - F.col("x0")) * (F.col("v0") - F.col("x0")) + (F.col("v1") - F.col("x1")) * (F.col("v1") - F.col("x1")) - F.col("w")
    v = v.withColumn("power", power).where(F.col("power") + top > 0)
    reach = F.sqrt(F.col("power") + top)
    inside = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    for a in (0, 1):
        v = v.withColumn(f"c{a}", F.sequence(inside(F.col(f"v{a}") - reach), inside(F.col(f"v{a}") + reach)))
    v = v.select("i", "h0", "h1", "v0", "v1", "power", F.explode("c0").alias("b0"), "c1").withColumn("b1", F.explode("c1"))
    v = v.where(F.greatest(F.abs(F.col("b0") - F.col("h0")), F.abs(F.col("b1") - F.col("h1"))) > ring)
    away = lambda p, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(p), F.col(p) - F.col(hi))
    cuts = away("v0", "lo0", "hi0") * away("v0", "lo0", "hi0") + away("v1", "lo1", "hi1") * away("v1", "lo1", "hi1") - F.col("top") < F.col("power") - 1e-12
    return v.join(boxes, ["b0", "b1"]).where(cuts).select("i", "b0", "b1").distinct()


def pruned_facets(seeds: DataFrame, domain: DataFrame, cells: int, ring: int = 1) -> DataFrame:
    """facets2 of the whole diagram, from the seeds that bound each cell by `plans.sweep.neighbours`.

    Seeds too many for that, and domains without end, take `ringed_facets` with a grid of cells x cells.
    """
    from ..plans.sweep import MOST_SEEDS, convex_ring, neighbours
    from .distributions import _cut

    border = convex_ring(np.array([tuple(r) for r in domain.select("n0", "n1", "off").collect()], float).reshape(-1, 3))  # a few planes
    whole = isinstance(seeds.schema["i"].dataType, T.IntegralType)
    if border is None or not whole or seeds.count() > MOST_SEEDS:
        return ringed_facets(seeds, domain, cells, ring)
    found = _cut(neighbours(seeds, border))
    placed = F.lit(True)
    for c in ("x0", "x1", "w"):
        placed &= F.abs(c) < float("inf")
    # All planes of the domain bound every cell that is not empty, and the whole domain is the cell of a seed without place.
    full = found.where("k is null").select("i").unionByName(seeds.where(~F.coalesce(placed, F.lit(False))).select("i"))
    walls = full.crossJoin(F.broadcast(domain)).withColumn("g", F.lit(None).cast("double"))
    return facets2(bisectors(seeds, 2, found.where("k is not null")).unionByName(walls), ["i"])


def ringed_facets(seeds: DataFrame, domain: DataFrame, cells: int, ring: int = 1) -> DataFrame:
    """facets2 of the whole diagram from candidates in nearby buckets, and from every bucket that pruning leaves open."""
    from .distributions import _cut

    pairs = ring_pairs(seeds, cells, ring)
    # Cells of the near candidates contain the true ones, so what cannot cut them cannot cut those.
    found = _cut(facets2(cell_planes(seeds, domain, 2, pairs), ["i"]))
    more = open_buckets(seeds, found, cells, ring).join(bucketed(seeds, cells).select(F.col("i").alias("k"), "b0", "b1"), ["b0", "b1"]).where("i <> k").select("i", "k")
    more = _cut(more)
    if more.isEmpty():
        return found
    return facets2(cell_planes(seeds, domain, 2, pairs.unionByName(more).distinct()), ["i"])
