"""Façade: diagrams as objects over seed tables; problems and distributions are re-exported."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import densities as Q
from .operators import diagram as P
from .operators.spatial import pruned_facets
from .plans.problem import BlackBox, Box, Direct, Image, Iterative, Mesh, OtNotConverged, OtProblem, Polygon, Polytope, SumOfDiracs, SumOfGaussians, laplacian_solve, ot_solve, plan, residual, w2
from .plans.quantize import quantization
from .sources.display import Scene, write_convergence_html

__all__ = ["BlackBox", "Box", "Direct", "Image", "Iterative", "Mesh", "OtNotConverged", "OtProblem", "Polygon", "Polytope", "PowerDiagram", "Scene", "SumOfDiracs", "SumOfGaussians", "Voronoi", "laplacian_solve", "ot_solve", "plan", "quantization", "residual", "w2", "write_convergence_html"]


class PowerDiagram:
    """A 2D diagram of seeds (i, x0, x1, w) in a convex domain (k, n0, n1, off), the unit square by default.

    buckets: side of the bucket grid for candidates; by default so many that a bucket has two seeds. 0 compares all pairs.
    """

    def __init__(self, seeds: DataFrame, domain: DataFrame | None = None, buckets: int | None = None):
        self.spark: SparkSession = seeds.sparkSession
        self.seeds, self.buckets = seeds if "w" in seeds.columns else seeds.withColumn("w", F.lit(0.0)), buckets
        self.domain = domain if domain is not None else P.unit_box(self.spark, 2)

    @cached_property
    def facets(self) -> DataFrame:
        buckets = max(1, int((self.seeds.count() / 2) ** 0.5)) if self.buckets is None else self.buckets
        return pruned_facets(self.seeds, self.domain, buckets) if buckets else P.facets2(P.cell_planes(self.seeds, self.domain, 2), ["i"])

    @cached_property
    def planes(self) -> DataFrame:
        """Those of the facets: a cell has no need of the others."""
        return self.facets.select("i", "k", "n0", "n1", "off", "g")

    @cached_property
    def placed(self) -> DataFrame:
        return P.placed2(self.facets, self.seeds, ["i"])

    @property
    def measures(self) -> DataFrame:
        return P.with_empty(self.seeds, P.measures2(self.placed, ["i"]), ["area"])

    @property
    def moments(self) -> DataFrame:
        return P.with_empty(self.seeds, P.moments(P.measures2(self.placed, ["i"]), ["i"]), ["mass", "s0", "s1", "r2"])

    def moment(self, k: int | str) -> DataFrame:
        """(i, moment): of 1 ("1"), a coordinate (0 or 1) or the squared norm ("r2")."""
        column = {"1": "mass", 0: "s0", 1: "s1", "r2": "r2"}[k]
        return self.moments.select("i", F.col(column).alias("moment"))

    def hessian_rows(self) -> DataFrame:
        return P.graph(self.placed).select("i", "k", "c")

    def laplacian_solve(self, rhs: DataFrame) -> DataFrame:
        """(i, x) with L x = rhs (i, v) and x of the first seed 0. The graph is solved on the driver."""
        import pyarrow as pa

        r = rhs.orderBy("i").toPandas()
        e, ids = self.hessian_rows().toPandas(), r["i"].to_numpy()
        x = laplacian_solve(len(ids), np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["k"]), e["c"].to_numpy(), r["v"].to_numpy(float))
        return self.spark.createDataFrame(pa.table({"i": ids, "x": x}))

    @property
    def cells(self) -> DataFrame:
        return P.vertices(self.facets, ["i"])

    def cell(self, i: int) -> DataFrame:
        return self.cells.where(F.col("i") == i)

    def support_pieces(self, tiles: DataFrame, threshold: float = 0.0) -> DataFrame:
        """(i, k0, k1, mass, ..): cells cut to the tiles whose density is above threshold times the largest."""
        most = tiles.agg(F.max("value")).first()[0] or 0.0
        return Q.grid_pieces(self.planes, tiles.where(F.col("value") > threshold * most))

    def density_moments(self, tiles: DataFrame) -> DataFrame:
        return Q.grid_moments(self.planes, tiles)

    def with_weights(self, weights: DataFrame) -> PowerDiagram:
        """The same positions and domain with other weights (i, w)."""
        return PowerDiagram(self.seeds.drop("w").join(weights, "i"), self.domain, self.buckets)


class Voronoi(PowerDiagram):
    """Without weights; a weight column is refused."""

    def __init__(self, seeds: DataFrame, domain: DataFrame | None = None, buckets: int | None = None):
        if "w" in seeds.columns:
            raise ValueError("a Voronoi diagram has no weights")
        super().__init__(seeds, domain, buckets)
