"""Power diagrams as relations.

A cell is the set of its planes (key.., k, n0, n1, [n2,] off), n.x <= off with unit n; k >= 0 is the neighbour seed, k < 0
a plane of the domain. A facet is what the other planes of the cell leave of a plane: a self-join on the cell and one
aggregation with maximum and minimum. Measures, moments, the neighbour graph and the derivatives are sums over facets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARALLEL = 1e-14
COINCIDENT = 1e-12
#: The measure of a cell without bounds.
UNBOUNDED = 1.7976931348623157e308


def unit_box(spark, d: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(k, n0.., off): the 2d half-spaces of a cube."""
    rows = []
    for a in range(d):
        for s, off in ((-1.0, -lo), (1.0, hi)):
            rows.append((-1 - len(rows), *[s if b == a else 0.0 for b in range(d)], off))
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"n{a} double" for a in range(d)) + ", off double")


def bisectors(seeds: DataFrame, d: int, pairs: DataFrame | None = None) -> DataFrame:
    """(i, k, n0.., off, g): the plane between i and each other seed; g is their distance. pairs (i, k) restricts them.

    Seeds at equal positions have no bisector; of those the heaviest, then the first, keeps its cell.
    """
    x = [f"x{a}" for a in range(d)]
    p = seeds.select(F.col("i"), *[F.col(c).alias("p" + c) for c in x], F.col("w").alias("pw"))
    q = seeds.select(F.col("i").alias("k"), *[F.col(c).alias("q" + c) for c in x], F.col("w").alias("qw"))
    both = p.join(q, F.col("i") != F.col("k")) if pairs is None else p.join(pairs, "i").join(q, "k")
    g = F.sqrt(reduce(lambda s, c: s + (F.col("q" + c) - F.col("p" + c)) * (F.col("q" + c) - F.col("p" + c)), x, F.lit(0.0)))
    both = both.withColumn("g", g).where("g > 0")
    half = reduce(lambda s, c: s + F.col("q" + c) * F.col("q" + c) - F.col("p" + c) * F.col("p" + c), x, F.col("pw") - F.col("qw")) / 2
    return both.select("i", "k", *[F.try_divide(F.col(f"qx{a}") - F.col(f"px{a}"), F.col("g")).alias(f"n{a}") for a in range(d)], F.try_divide(half, F.col("g")).alias("off"), "g")


def cell_planes(seeds: DataFrame, domain: DataFrame, d: int, pairs: DataFrame | None = None) -> DataFrame:
    """(i, k, n.., off, g): bisectors and domain planes of every cell; g is null for the domain's."""
    walls = seeds.select("i").crossJoin(F.broadcast(domain)).withColumn("g", F.lit(None).cast("double"))
    return bisectors(seeds, d, pairs).unionByName(walls)


def add_planes(planes: DataFrame, more: DataFrame, keys: list[str], of: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Planes of the cells cut again: each plane set of more (of.., k, n.., off) makes its own piece of the cells.

    pairs (keys.., of..) says which cells a set may meet; without it every one meets all.
    """
    if pairs is None:
        pairs = planes.select(*keys).distinct().crossJoin(more.select(*of).distinct())
    own = planes.join(pairs, keys)
    new = pairs.join(more, of).withColumn("g", F.lit(None).cast("double"))
    return own.unionByName(new.select(*own.columns))


def facets2(planes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., k, n0, n1, off, g, lo, hi): the part of each plane that the others leave, from lo to hi along (-n1, n0).

    lo or hi is null where it has no end. Of planes that coincide the one of the largest k has the facet.
    """
    f = planes.select(*keys, "k", "n0", "n1", "off", "g")
    h = planes.select(*keys, F.col("k").alias("hk"), F.col("n0").alias("h0"), F.col("n1").alias("h1"), F.col("off").alias("hoff"))
    c = F.col("h1") * F.col("n0") - F.col("h0") * F.col("n1")
    r = F.col("hoff") - F.col("off") * (F.col("h0") * F.col("n0") + F.col("h1") * F.col("n1"))
    both = f.join(h, keys).where("hk <> k").withColumn("c", c).withColumn("r", r)
    out = both.groupBy(*keys, "k").agg(
        *[F.first(x).alias(x) for x in ("n0", "n1", "off", "g")],
        F.max(F.when(F.col("c") < -PARALLEL, F.try_divide("r", "c"))).alias("lo"),
        F.min(F.when(F.col("c") > PARALLEL, F.try_divide("r", "c"))).alias("hi"),
        F.min(F.when(F.abs("c") <= PARALLEL, F.col("r"))).alias("par"),
        F.max((F.abs("c") <= PARALLEL) & (F.abs("r") <= COINCIDENT) & (F.col("h0") * F.col("n0") + F.col("h1") * F.col("n1") > 0) & (F.col("hk") > F.col("k"))).alias("twin"),
    )
    return out.where("(lo is null or hi is null or hi > lo) and (par is null or par >= -1e-12) and not twin").drop("par", "twin")


def placed2(facets: DataFrame, points: DataFrame | None, keys: list[str]) -> DataFrame:
    """facets with p0, p1 (the cell's point, or the origin), h its distance to the plane, and t0, t1 from its foot."""
    if points is None:
        rows = facets.withColumns({"p0": F.lit(0.0), "p1": F.lit(0.0)})
    else:
        rows = facets.join(points.select(keys[0], F.col("x0").alias("p0"), F.col("x1").alias("p1")), keys[0])
    along = F.col("n0") * F.col("p1") - F.col("n1") * F.col("p0")
    return rows.withColumns({"h": F.col("off") - F.col("n0") * F.col("p0") - F.col("n1") * F.col("p1"), "t0": F.col("lo") - along, "t1": F.col("hi") - along})


def _sums2() -> dict[str, Column]:
    """Area, first moments about p and second moment about p, as sums over placed facets."""
    length, h = F.col("t1") - F.col("t0"), F.col("h")
    half = (F.col("t1") * F.col("t1") - F.col("t0") * F.col("t0")) / 2
    third = (F.pow("t1", F.lit(3)) - F.pow("t0", F.lit(3))) / 3
    return {
        "area": F.sum(h * length / 2),
        "m0": F.sum(h / 3 * (h * F.col("n0") * length - F.col("n1") * half)),
        "m1": F.sum(h / 3 * (h * F.col("n1") * length + F.col("n0") * half)),
        "q": F.sum(h / 4 * (h * h * length + third)),
    }


def measures2(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., area, m0, m1, q, p0, p1); a cell with an open facet has the measure UNBOUNDED."""
    open_ = F.max((F.col("t0").isNull() | F.col("t1").isNull()).cast("int")) == 1
    rows = placed.groupBy(*keys).agg(*[e.alias(n) for n, e in _sums2().items()], F.first("p0").alias("p0"), F.first("p1").alias("p1"), open_.alias("is_open"))
    return rows.withColumn("area", F.when(F.col("is_open"), F.lit(UNBOUNDED)).otherwise(F.col("area"))).drop("is_open")


def moments(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., mass, s0, s1, r2): integrals of 1, x, y and |x|^2 over the cells."""
    s0, s1 = F.col("m0") + F.col("p0") * F.col("area"), F.col("m1") + F.col("p1") * F.col("area")
    r2 = F.col("q") + 2 * (F.col("p0") * F.col("m0") + F.col("p1") * F.col("m1")) + (F.col("p0") * F.col("p0") + F.col("p1") * F.col("p1")) * F.col("area")
    return measured.select(*keys, F.col("area").alias("mass"), s0.alias("s0"), s1.alias("s1"), r2.alias("r2"))


def with_empty(seeds: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """A row for every seed, 0 where its cell is empty."""
    return seeds.select("i").join(found, "i", "left").select("i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def graph(placed: DataFrame) -> DataFrame:
    """(i, k, c, e0, e1): neighbours, length over twice their distance, and the facet's middle."""
    rows = placed.where("k >= 0")
    mid = (F.col("lo") + F.col("hi")) / 2
    return rows.select("i", "k", ((F.col("t1") - F.col("t0")) / (2 * F.col("g"))).alias("c"), (F.col("off") * F.col("n0") - mid * F.col("n1")).alias("e0"), (F.col("off") * F.col("n1") + mid * F.col("n0")).alias("e1"))


def vertices(facets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., k, x0, x1): the end from which each facet goes on counter-clockwise, one vertex per facet."""
    return facets.select(*keys, "k", (F.col("off") * F.col("n0") - F.col("lo") * F.col("n1")).alias("x0"), (F.col("off") * F.col("n1") + F.col("lo") * F.col("n0")).alias("x1"))


def simplices(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., k, x00, x01, x10, x11, x20, x21, area): the triangle from the cell's point to each facet; areas are signed and add up."""
    end = lambda t: [F.col("off") * F.col("n0") - F.col(t) * F.col("n1"), F.col("off") * F.col("n1") + F.col(t) * F.col("n0")]
    corner = [F.col("p0"), F.col("p1"), *end("lo"), *end("hi")]
    return placed.select(*keys, "k", *[c.alias(f"x{j // 2}{j % 2}") for j, c in enumerate(corner)], (F.col("h") * (F.col("t1") - F.col("t0")) / 2).alias("area"))


def vertex_gradient(facets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., k, grad0, grad1): a bounded cell's area by the vertex from which facet k goes on: across the line from the vertex before to the one after."""
    end = lambda t: [F.col("off") * F.col("n0") - F.col(t) * F.col("n1"), F.col("off") * F.col("n1") + F.col(t) * F.col("n0")]
    (a0, a1), (b0, b1) = end("lo"), end("hi")
    own = facets.select(*keys, "k", a0.alias("v0"), a1.alias("v1"), b0.alias("w0"), b1.alias("w1"), ((b1 - a1) / 2).alias("g0"), ((a0 - b0) / 2).alias("g1"))
    # The facet before ends where this one starts; of a cell's facets its direction is the one before in angle.
    turn = Window.partitionBy(*keys).orderBy("angle")
    back = Window.partitionBy(*keys)
    angle = F.atan2(F.col("w1") - F.col("v1"), F.col("w0") - F.col("v0"))
    rows = own.withColumn("angle", angle)
    for g in ("g0", "g1"):
        rows = rows.withColumn(f"last{g}", F.max_by(g, "angle").over(back)).withColumn(f"before{g}", F.lag(g).over(turn))
    return rows.select(*keys, "k", *[(F.col(f"g{a}") + F.coalesce(f"beforeg{a}", f"lastg{a}")).alias(f"grad{a}") for a in (0, 1)])


def bounded(facets: DataFrame, keys: list[str]) -> DataFrame:
    return facets.groupBy(*keys).agg(F.min((F.col("lo").isNotNull() & F.col("hi").isNotNull()).cast("int")).alias("is_bounded"), F.count("*").alias("n_facets"))


def membership(points: DataFrame, seeds: DataFrame, cells: int | None = None) -> DataFrame:
    """(q, i): the seed of least power distance to each point, the first index on ties.

    Points meet the seeds of the buckets around their own. A point is done when no seed further away can be nearer in
    power, by its distance to the border of those buckets and the largest weight; the others look around twice as far.
    """
    from .distributions import _cut
    from .spatial import bucketed

    found = seeds.agg(F.count("*").alias("n"), F.max("w").alias("top")).first()
    if not found["n"]:
        return points.select("q", F.lit(None).cast("long").alias("i")).limit(0)
    cells = cells or max(1, int((found["n"] / 2) ** 0.5))
    sites = bucketed(seeds, cells).select("i", F.col("x0").alias("s0"), F.col("x1").alias("s1"), "w", "b0", "b1")
    left, ring, out = bucketed(points, cells).select("q", "x0", "x1", "b0", "b1"), 1, None
    square = lambda a: (F.col(f"x{a}") - F.col(f"s{a}")) * (F.col(f"x{a}") - F.col(f"s{a}"))
    while True:
        near = left
        for a in (0, 1):  # the buckets around, as far as the grid goes
            low, high = F.greatest(F.col(f"b{a}") - ring, F.lit(0)), F.least(F.col(f"b{a}") + ring, F.lit(cells - 1))
            free = [F.when(low > 0, F.col(f"x{a}") - low / cells), F.when(high < cells - 1, (high + 1) / cells - F.col(f"x{a}"))]
            near = near.withColumn(f"free{a}", F.least(*[F.coalesce(c, F.lit(float("inf"))) for c in free])).withColumn(f"c{a}", F.sequence(low, high))
        free = F.least("free0", "free1")
        near = near.select("q", "x0", "x1", "b0", "b1", (free * free).alias("free"), F.explode("c0").alias("c0"), "c1").withColumn("c1", F.explode("c1"))
        met = near.join(sites.withColumnsRenamed({"b0": "c0", "b1": "c1"}), ["c0", "c1"], "left").withColumn("power", square(0) + square(1) - F.col("w"))
        best = met.groupBy("q", "x0", "x1", "b0", "b1", "free").agg(F.min(F.when(F.col("i").isNotNull(), F.struct("power", "i"))).alias("best"))
        best = _cut(best.withColumn("done", F.coalesce(F.col("best.power") < F.col("free") - found["top"], F.col("free") == float("inf"))))
        done = best.where("done").select("q", F.col("best.i").alias("i"))
        out = done if out is None else out.unionByName(done)
        left = best.where("not done").select("q", "x0", "x1", "b0", "b1")
        if ring >= cells or left.isEmpty():
            return out
        ring *= 2


def vjp_weights(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(i, grad): sum over neighbours of c (g_i - g_k), the measures' derivative by weights applied to values (i, v)."""
    other = values.select(F.col("i").alias("k"), F.col("v").alias("vk"))
    return edges.join(values, "i").join(other, "k").groupBy("i").agg(F.sum(F.col("c") * (F.col("v") - F.col("vk"))).alias("grad"))


def vjp_positions(edges: DataFrame, values: DataFrame, seeds: DataFrame) -> DataFrame:
    """(i, grad0, grad1): sum over neighbours of 2 c (g_i - g_k) (middle of the facet - p)."""
    other = values.select(F.col("i").alias("k"), F.col("v").alias("vk"))
    rows = edges.join(values, "i").join(other, "k").join(seeds.select("i", "x0", "x1"), "i")
    factor = 2 * F.col("c") * (F.col("v") - F.col("vk"))
    return rows.groupBy("i").agg(F.sum(factor * (F.col("e0") - F.col("x0"))).alias("grad0"), F.sum(factor * (F.col("e1") - F.col("x1"))).alias("grad1"))


def edges3(planes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., k, j, h stuff): edges of 3D cells: the line of two planes of a cell, clipped by all the others."""
    col = lambda p, n: [F.col(n[a]).alias(f"{p}{a}") for a in range(3)]
    n = ["n0", "n1", "n2"]
    f = planes.select(*keys, "k", *col("f", n), F.col("off").alias("fo"), "g")
    s = planes.select(*keys, F.col("k").alias("j"), *col("s", n), F.col("off").alias("so"))
    pairs = f.join(s, keys).where("j <> k")
    cross = lambda a, b: [F.col(f"{a}{(i + 1) % 3}") * F.col(f"{b}{(i + 2) % 3}") - F.col(f"{a}{(i + 2) % 3}") * F.col(f"{b}{(i + 1) % 3}") for i in range(3)]
    pairs = pairs.withColumns({f"u{i}": c for i, c in enumerate(cross("f", "s"))})
    pairs = pairs.withColumn("u", F.sqrt(F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1") + F.col("u2") * F.col("u2"))).where("u > 1e-12")
    cosine = F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1") + F.col("f2") * F.col("s2")
    # The line's point nearest to the origin is a f + b s.
    pairs = pairs.withColumn("cos", cosine).withColumns({"a": F.try_divide(F.col("fo") - F.col("so") * F.col("cos"), F.col("u") * F.col("u")), "b": F.try_divide(F.col("so") - F.col("fo") * F.col("cos"), F.col("u") * F.col("u"))})
    pairs = pairs.select(*keys, "k", "j", "g", "fo", *[f"f{i}" for i in range(3)], *[f"s{i}" for i in range(3)], *[F.try_divide(f"u{i}", "u").alias(f"d{i}") for i in range(3)], *[(F.col("a") * F.col(f"f{i}") + F.col("b") * F.col(f"s{i}")).alias(f"o{i}") for i in range(3)])
    h = planes.select(*keys, F.col("k").alias("l"), *col("h", n), F.col("off").alias("ho"))
    c = F.col("h0") * F.col("d0") + F.col("h1") * F.col("d1") + F.col("h2") * F.col("d2")
    r = F.col("ho") - (F.col("h0") * F.col("o0") + F.col("h1") * F.col("o1") + F.col("h2") * F.col("o2"))
    clipped = pairs.join(h, keys).where("l <> k and l <> j").withColumn("c", c).withColumn("r", r)
    kept = ["g", "fo", *[f"{p}{i}" for p in "fsdo" for i in range(3)]]
    out = clipped.groupBy(*keys, "k", "j").agg(
        *[F.first(x).alias(x) for x in kept],
        F.max(F.when(F.col("c") < -1e-12, F.try_divide("r", "c"))).alias("lo"),
        F.min(F.when(F.col("c") > 1e-12, F.try_divide("r", "c"))).alias("hi"),
        F.min(F.when(F.abs("c") <= 1e-12, F.col("r"))).alias("par"),
    )
    return out.where("hi > lo and (par is null or par >= -1e-13)")


def facets3(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(i, k, h, area, g): areas of 3D facets, summed over their edges seen from the foot of the seed, and its distance h."""
    rows = edges.join(seeds.select("i", *[F.col(f"x{a}").alias(f"p{a}") for a in range(3)]), "i")
    h = F.col("fo") - sum((F.col(f"f{a}") * F.col(f"p{a}") for a in range(3)), F.lit(0.0))
    rows = rows.withColumn("h", h)
    # Outward normal of the edge within the facet: what of s is across f.
    cosine = sum((F.col(f"f{a}") * F.col(f"s{a}") for a in range(3)), F.lit(0.0))
    rows = rows.withColumn("cos", cosine).withColumn("sin", F.sqrt(1 - F.col("cos") * F.col("cos")))
    away = sum(((F.col(f"o{a}") - F.col(f"p{a}") - F.col("h") * F.col(f"f{a}")) * F.try_divide(F.col(f"s{a}") - F.col("cos") * F.col(f"f{a}"), F.col("sin")) for a in range(3)), F.lit(0.0))
    return rows.groupBy("i", "k").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.sum(away * (F.col("hi") - F.col("lo")) / 2).alias("area"))


def measures3(facets: DataFrame) -> DataFrame:
    """(i, volume)."""
    return facets.groupBy("i").agg(F.sum(F.col("h") * F.col("area") / 3).alias("volume"))
