"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b longs); component is its smallest node.

    Each round points every node's larger neighbours, then every node and its smaller ones, at the smallest of them;
    rounds end when nothing changes, after a number of them that grows with the logarithm of the longest path.
    Minima are taken before rows meet them, so a node with very many neighbours is pre-aggregated; lineage is cut in
    the shared folder after each round. Null ends and loops are ignored; repeated edges are one.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = materialize(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        before = tuple(now)
