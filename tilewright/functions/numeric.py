"""Rounding for publication, and running sums that do not end in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, -0 as 0: sums depend on their order in the last bits."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_total(df: DataFrame, value: Column | str, name: str, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """df with the sum of value over its batch: one row a batch is summed first and joined, so no task holds a batch."""
    value = F.col(value) if isinstance(value, str) else value
    if not batch:
        return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias(name))))  # one row
    of = {c: f"__of_{c}" for c in batch}
    total = df.groupBy(*[F.col(c).alias(of[c]) for c in batch]).agg(F.sum(value).alias(name))
    on = F.lit(True)
    for c in batch:
        on &= F.col(c).eqNullSafe(F.col(of[c]))
    return df.join(total, on).drop(*of.values())


def running(df: DataFrame, value: str, order: list[str], batch: list[str], before: str, after: str, parts: int | None = None) -> DataFrame:
    """df with two columns more: the sum of value over the rows of the batch before this one, and up to it.

    Rows fall into ranges of the first ordering column, whose bounds are approximate quantiles taken beforehand; each
    range sums its own rows, and one row per range and batch says what came before it. The largest task holds one
    range of one batch, whatever the batch.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    in_range = F.lit(0)
    for c in cuts:
        in_range += (F.col(order[0]) >= c).cast("int")
    ranged = df.withColumn("__range", in_range)
    own = Window.partitionBy("__range", *batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__upto", F.sum(value).over(own))
    ends = ranged.groupBy("__range", *batch).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*batch).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*batch, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"))
    on = F.col("a.__range") == F.col("b.__range")
    for c in batch:
        on &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = local.alias("a").join(ends.alias("b"), on)
    upto = F.col("b.__before") + F.col("a.__upto")
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (upto - F.col(f"a.{value}")).alias(before), upto.alias(after))


def gauss_legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights on [0, 1]."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return [((float(a) + 1) / 2, float(b) / 2) for a, b in zip(x, w, strict=True)]


def between(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))
