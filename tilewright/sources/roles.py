"""Roles that the driver tables play: point sets and densities derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balance_diracs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x, w): suppliers at their balances, in thousands, with equal weights."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 1000).alias("x"), F.lit(1.0).alias("w"))


def balance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lo, hi, value): histogram of customers' balances in bins of 500."""
    k = F.floor((F.col("c_acctbal") + 1000) / 500).cast("int")
    bins = read(spark, sf_dir, "customer").groupBy(k.alias("k")).agg(F.count("*").cast("double").alias("value"))
    return bins.select("k", (F.col("k") * 0.5 - 1).alias("lo"), (F.col("k") * 0.5 - 0.5).alias("hi"), "value")


def order_diracs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, i, x, w): events at their values, by type."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("batch"), F.col("event_id").alias("i"), (F.col("value") / 100).alias("x"), F.lit(1.0).alias("w"))


def event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, k, lo, hi, value): for each type the histogram of all events' values in bins of a tenth."""
    events = read(spark, sf_dir, "events")
    bins = events.groupBy(F.floor(F.col("value") / 10).cast("int").alias("k")).agg(F.count("*").cast("double").alias("value"))
    bins = bins.select("k", (F.col("k") / 10.0).alias("lo"), ((F.col("k") + 1) / 10.0).alias("hi"), "value")
    return events.select(F.col("event_type").alias("batch")).distinct().crossJoin(F.broadcast(bins))  # a few types, a few bins


def nation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x0, x1, x2, w): one point per nation in the unit cube, scattered by its customers' cents, and a small weight."""
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("long"))
    sums = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(cents.alias("s"), F.sum("c_custkey").alias("t"))
    unit = lambda n, m: (F.pmod(n, F.lit(m)) + 0.5) / float(m)
    return sums.select("i", unit(F.col("s"), 997).alias("x0"), unit(F.col("t") + F.col("s"), 991).alias("x1"), unit(F.col("t") * 7, 983).alias("x2"), ((F.pmod("t", F.lit(7)) - 3) / 500.0).alias("w"))


def supplier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x0, x1, w): one point per supplier in the unit square."""
    spread = (F.pmod(F.col("s_suppkey") * 7919, F.lit(10007)) + 0.5) / 10007.0
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), ((F.col("s_acctbal") + 1000) / 11000).alias("x0"), spread.alias("x1"), F.lit(0.0).alias("w"))


def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, x0, x1): parts in the unit square, by price and size."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), (F.pmod(F.round(F.col("p_retailprice") * 100).cast("long"), F.lit(9973)) / 9973.0).alias("x0"), (F.pmod(F.col("p_partkey") * 31 + F.col("p_size"), F.lit(9967)) / 9967.0).alias("x1"))


def sales_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k0, k1, lo0, hi0, lo1, hi1, value): all line items in a 4 x 5 grid over the unit square, by discount and quantity."""
    k0 = F.least(F.floor(F.col("l_discount") * 40), F.lit(3)).cast("int")
    k1 = F.least(F.floor((F.col("l_quantity") - 1) / 10), F.lit(4)).cast("int")
    rows = read(spark, sf_dir, "lineitem").groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.count("*").alias("n"))
    return rows.select("k0", "k1", (F.col("k0") / 4.0).alias("lo0"), ((F.col("k0") + 1) / 4.0).alias("hi0"), (F.col("k1") / 5.0).alias("lo1"), ((F.col("k1") + 1) / 5.0).alias("hi1"), (F.col("n") / 1000.0).alias("value"))


def region_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, c0, c1, sigma, mass): one isotropic gaussian per region, weighted by its customers."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("g")).agg(F.count("*").cast("double").alias("mass"))
    return rows.select("g", ((F.col("g") * 2 + 1) / 11.0).alias("c0"), ((F.pmod(F.col("g") * 3, F.lit(5)) + 0.5) / 5.0).alias("c1"), (0.08 + F.col("g") * 0.02).alias("sigma"), "mass")


def grid_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (v, x0, x1) and corners (e, c, v, value): the 4 x 5 grid's nodes, two triangles a tile, sales as values."""
    nodes = spark.range(30).select(F.col("id").alias("v"), (F.floor(F.col("id") / 6) / 4.0).alias("x0"), (F.pmod("id", F.lit(6)) / 5.0).alias("x1"))
    base = F.col("k0") * 6 + F.col("k1")
    corner = lambda e, c, d, f: F.struct((F.col("k0") * 10 + F.col("k1") * 2 + e).cast("long").alias("e"), F.lit(c).alias("c"), (base + d).cast("long").alias("v"), (F.col("value") + f).alias("value"))
    parts = [corner(0, 0, 0, 0.0), corner(0, 1, 6, 0.5), corner(0, 2, 1, 1.0), corner(1, 0, 7, 0.25), corner(1, 1, 1, 0.0), corner(1, 2, 6, 0.75)]
    corners = sales_tiles(spark, sf_dir).select(F.inline(F.array(*parts)))
    return nodes, corners
