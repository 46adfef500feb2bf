"""Transport on a line: diracs (batch, i, x, w) to a grid density (batch, k, lo, hi, value).

Both sides become intervals of the mass axis by running sums; a piece is what a dirac's interval and a bin's share.
The mass axis is cut into buckets; an interval is clipped to the buckets it touches. Within a bucket the starts of both
sides are put in one order: from each start to the next, the last dirac and the last bin to start share a piece, so there
are as many pieces as starts. All results are sums of integrals over pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import running, with_total

BUCKETS = 64


def source_intervals(diracs: DataFrame, batch: list[str] = [], presorted: bool = False) -> DataFrame:  # noqa: B006
    """(batch, i, x, w, w0, w1): weights normalised per batch, in the order of (x, i). presorted: x is ascending in i."""
    normal = with_total(diracs.select(*batch, "i", "x", "w"), "w", "__mass", batch)
    normal = normal.select(*batch, "i", "x", (F.col("w") / F.col("__mass")).alias("w"))
    return running(normal, "w", ["i"] if presorted else ["x", "i"], batch, "w0", "w1")


def target_intervals(bins: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, k, lo, hi, y, m, c0, c1): densities y and masses m of normalised bins, with their cumulated masses."""
    width = F.col("hi") - F.col("lo")
    normal, mass = with_total(bins.select(*batch, "k", "lo", "hi", "value"), F.col("value") * width, "__mass", batch), F.col("__mass")
    normal = normal.select(*batch, "k", "lo", "hi", (F.col("value") / mass).alias("y"), (F.col("value") * width / mass).alias("m"))
    return running(normal, "m", ["lo"], batch, "c0", "c1")


def _starts(df: DataFrame, start: str, stop: str, buckets: int, batch: list[str], side: str, payload: list[str]) -> DataFrame:
    """(batch, bucket, m0, payload): where a row's interval starts in each bucket that it touches."""
    at = lambda c: F.greatest(F.least(F.floor(F.col(c) * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")
    rows = df.where(F.col(stop) > F.col(start)).withColumn("bucket", F.explode(F.sequence(at(start), at(stop))))
    rows = rows.withColumn("m0", F.greatest(F.col(start), F.col("bucket") / buckets)).where(F.col("m0") < F.col(stop))
    return rows.select(*batch, "bucket", "m0", F.struct(*payload, F.col(stop).alias("end")).alias(side))


def pieces(source: DataFrame, target: DataFrame, batch: list[str] = [], buckets: int | None = None) -> DataFrame:  # noqa: B006
    """(batch, i, k, p, w, y, x0, x1): each dirac's share of each bin, from x0 to x1, once per bucket."""
    buckets = buckets or max(BUCKETS, 4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = _starts(source, "w0", "w1", buckets, batch, "d", ["i", "x", "w"])
    b = _starts(target.where("m > 0"), "c0", "c1", buckets, batch, "b", ["k", "lo", "c0", "y"])
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*batch, "bucket").orderBy("m0")
    last = order.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("bucket") == buckets - 1, F.lit(2.0)).otherwise((F.col("bucket") + 1) / buckets)
    found = both.select(*batch, "m0", F.lead("m0").over(order).alias("next"), edge.alias("edge"), F.last("d", ignorenulls=True).over(last).alias("d"), F.last("b", ignorenulls=True).over(last).alias("b"))
    found = found.withColumn("m1", F.least("next", "edge", "d.end", "b.end")).where("m1 > m0 and d is not null and b is not null")
    at = lambda m: F.col("b.lo") + F.try_divide(F.col(m) - F.col("b.c0"), F.col("b.y"))
    return found.select(*batch, "d.i", "b.k", F.col("d.x").alias("p"), "d.w", "b.y", at("m0").alias("x0"), at("m1").alias("x1"))


def second_moment() -> Column:
    """Integral of (x - p)^2 over a piece."""
    return (F.pow(F.col("x1") - F.col("p"), F.lit(3)) - F.pow(F.col("x0") - F.col("p"), F.lit(3))) / 3


def cost(parts: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, cost): the squared Wasserstein distance."""
    return parts.groupBy(*batch).agg(F.sum(F.col("y") * second_moment()).alias("cost"))


def barycenters(parts: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, i, p, mass, barycenter, cost, grad_position): grad_position is 2 w (p - b)."""
    mass = F.sum(F.col("y") * (F.col("x1") - F.col("x0")))
    moment = F.sum(F.col("y") * (F.col("x1") * F.col("x1") - F.col("x0") * F.col("x0")) / 2)
    rows = parts.groupBy(*batch, "i", "p").agg(mass.alias("mass"), moment.alias("moment"), F.sum(F.col("y") * second_moment()).alias("cost"))
    return rows.select(*batch, "i", "p", "mass", F.try_divide("moment", "mass").alias("barycenter"), "cost", (2 * (F.col("p") * F.col("mass") - F.col("moment"))).alias("grad_position"))


def weight_gradient(parts: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, i, phi): derivative of the cost by the weight of i when all later slices move on.

    At the end x of a slice the potential jumps by (x - p)^2 - (x - p')^2, p' the next dirac; phi sums the jumps from
    a slice's own end on, with (x - p)^2 at the last.
    """
    ends = parts.groupBy(*batch, "i", "p").agg(F.max("x1").alias("end"), F.lit(1.0).alias("one"))
    ranked = running(ends, "one", ["p", "i"], batch, "rank", "after")
    later = ranked.select(*batch, F.col("rank").alias("after"), F.col("p").alias("next"))
    square = lambda a: (F.col("end") - a) * (F.col("end") - a)
    jumps = ranked.join(later, [*batch, "after"], "left")
    jumps = jumps.select(*batch, "i", "p", (square(F.col("p")) - F.coalesce(square(F.col("next")), F.lit(0.0))).alias("jump"))
    return running(with_total(jumps, "jump", "__all", batch), "jump", ["p", "i"], batch, "before", "upto").select(*batch, "i", (F.col("__all") - F.col("before")).alias("phi"))


def value_gradient(parts: DataFrame, phi: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, k, grad_value): derivative of the cost by a bin's density, target mass not renormalised."""
    rows = parts.join(phi, [*batch, "i"])
    return rows.groupBy(*batch, "k").agg(F.sum(second_moment() - F.col("phi") * (F.col("x1") - F.col("x0"))).alias("grad_value"))


def closed_form_cost(source: DataFrame, target: DataFrame, batch: list[str] = []) -> DataFrame:  # noqa: B006
    """(batch, cost) by prefix moments: a slice's integrals are differences of the target's running moments at its ends.

    The ends find their bins as of their mass, in one order of ends and bins together, bucket by bucket of the mass axis; a
    bin stands in each bucket that it touches.
    """
    buckets = max(BUCKETS, 4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moments = target.where("m > 0").withColumn("f1", F.col("y") * (F.col("hi") * F.col("hi") - F.col("lo") * F.col("lo")) / 2).withColumn("f2", F.col("y") * (F.pow("hi", F.lit(3)) - F.pow("lo", F.lit(3))) / 3)
    for f in ("f1", "f2"):
        moments = running(moments, f, ["lo"], batch, f + "b", f + "a")
    bin_ = F.struct("lo", "hi", "y", "c0", "f1b", "f2b")
    of = lambda c: F.greatest(F.least(F.floor(c * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")
    marks = moments.select(*batch, F.col("c0").alias("at"), F.lit(0).alias("kind"), bin_.alias("bin"), F.explode(F.sequence(of(F.col("c0")), of(F.col("c1")))).alias("bucket"))
    side = F.explode(F.array(F.struct(F.col("w0").alias("at"), F.lit(-1).alias("side")), F.struct(F.col("w1").alias("at"), F.lit(1).alias("side"))))
    ends = source.withColumn("e", side).select(*batch, F.col("e.at").alias("at"), F.lit(1).alias("kind"), F.col("x").alias("p"), F.col("e.side").alias("side"), of(F.col("e.at")).alias("bucket"))
    order = Window.partitionBy(*batch, "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(ends, allowMissingColumns=True).withColumn("b", F.last("bin", ignorenulls=True).over(order)).where("kind = 1")
    x = F.least(F.col("b.lo") + (F.col("at") - F.col("b.c0")) / F.col("b.y"), F.col("b.hi"))
    lo, y = F.col("b.lo"), F.col("b.y")
    m1 = F.col("b.f1b") + y * (x * x - lo * lo) / 2
    m2 = F.col("b.f2b") + y * (F.pow(x, F.lit(3)) - F.pow(lo, F.lit(3))) / 3
    return rows.groupBy(*batch).agg(F.sum(F.col("side") * (m2 - 2 * F.col("p") * m1 + F.col("p") * F.col("p") * F.col("at"))).alias("cost"))


def projected(points: DataFrame, angles: DataFrame, coordinates: list[str]) -> DataFrame:
    """(batch, i, x, w): each point's position along each direction (batch, n0, n1, ..); directions are few."""
    dot = sum((F.col(c) * F.col(f"n{a}") for a, c in enumerate(coordinates)), F.lit(0.0))
    return points.crossJoin(F.broadcast(angles)).select("batch", "i", dot.alias("x"), "w")


def projected_adjoint(gradients: DataFrame, angles: DataFrame, dim: int) -> DataFrame:
    """(i, g0, g1, ..): gradients by projected position, scattered back to the points that all directions share."""
    return gradients.join(F.broadcast(angles), "batch").groupBy("i").agg(*[F.sum(F.col("grad_position") * F.col(f"n{a}")).alias(f"g{a}") for a in range(dim)])
