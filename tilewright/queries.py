"""Queries over the driver tables, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import gauss_legendre, rounded
from .operators import densities as Q
from .operators import diagram as P
from .operators import distributions as D
from .operators import spatial as I
from .operators import tensor as A
from .operators import transport1d as T
from .sources import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a query, its doubles rounded, and its SQL: @name is a shared part, $x is round(x) as here."""
    def wrap(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = _expand(sql, digits)
        return f

    return wrap


PARTS = {
    "diracs": "d as (select s_suppkey as i, s_acctbal / 1000 as x, 1.0::double as w from supplier)",
    "bins": "b as (select k, k * 0.5 - 1 as lo, k * 0.5 - 0.5 as hi, n::double as value from (select floor((c_acctbal + 1000) / 500)::int as k, count(*) as n from customer group by 1))",
    "line": """s0 as (select i, x as p, w / sum(w) over () as w from d),
s as (select *, coalesce(sum(w) over (order by p, i rows between unbounded preceding and 1 preceding), 0) as w0, sum(w) over (order by p, i rows unbounded preceding) as w1 from s0),
t0 as (select k, lo, hi, value / sum(value * (hi - lo)) over () as y from b),
t1 as (select *, y * (hi - lo) as m from t0),
t as (select *, coalesce(sum(m) over (order by lo rows between unbounded preceding and 1 preceding), 0) as c0, sum(m) over (order by lo rows unbounded preceding) as c1 from t1),
pc as (select i, k, p, w, y, lo + (greatest(w0, c0) - c0) / y as x0, lo + (least(w1, c1) - c0) / y as x1 from s join t on w0 < c1 and c0 < w1 where m > 0),
f0 as (select i, p, max(x1) as e from pc group by i, p),
f1 as (select i, p, (e - p) ** 2 - coalesce((e - lead(p) over (order by p, i)) ** 2, 0) as j from f0),
phi as (select i, sum(j) over (order by p, i rows between current row and unbounded following) as phi from f1)""",
    "seeds": """z as (select c_nationkey::bigint as i, sum(round(c_acctbal * 100)::bigint)::bigint as s, sum(c_custkey)::bigint as t from customer group by 1),
seed as (select i, (((s % 997) + 997) % 997 + 0.5) / 997.0 as x0, ((((t + s) % 991) + 991) % 991 + 0.5) / 991.0 as x1, ((t * 7) % 983 + 0.5) / 983.0 as x2, ((t % 7) - 3) / 500.0 as w from z)""",
    "planes": """box as (select * from (values (-1, -1.0, 0.0, 0.0), (-2, 1.0, 0.0, 1.0), (-3, 0.0, -1.0, 0.0), (-4, 0.0, 1.0, 1.0)) v(k, n0, n1, off)),
bis as (select p.i, q.i as k, q.x0 - p.x0 as d0, q.x1 - p.x1 as d1, sqrt((q.x0 - p.x0) ** 2 + (q.x1 - p.x1) ** 2) as g, (q.x0 ** 2 + q.x1 ** 2 - p.x0 ** 2 - p.x1 ** 2 + p.w - q.w) / 2 as o from seed p join seed q on p.i <> q.i),
pl as (select i, k, d0 / g as n0, d1 / g as n1, o / g as off, g from bis where g > 0 union all select seed.i, box.k, n0::double, n1::double, off::double, null from seed, box)""",
    "facets": "@planes, fa as (@clip(pl|i))",
    "sums": """pf as (select f.*, x0 as p0, x1 as p1, off - n0 * x0 - n1 * x1 as h, lo - (n0 * x1 - n1 * x0) as t0, hi - (n0 * x1 - n1 * x0) as t1 from fa f join seed using (i)),
me as (select i, any_value(p0) as p0, any_value(p1) as p1, sum(h * (t1 - t0) / 2) as area, sum(h / 3 * (h * n0 * (t1 - t0) - n1 * (t1 ** 2 - t0 ** 2) / 2)) as m0, sum(h / 3 * (h * n1 * (t1 - t0) + n0 * (t1 ** 2 - t0 ** 2) / 2)) as m1, sum(h / 4 * (h * h * (t1 - t0) + (t1 ** 3 - t0 ** 3) / 3)) as q from pf group by i),
ed as (select i, k, (t1 - t0) / (2 * g) as c, off * n0 - (lo + hi) / 2 * n1 as e0, off * n1 + (lo + hi) / 2 * n0 as e1 from pf where k >= 0)""",
    "tiles": """tiles as (select k0, k1, k0 / 4.0 as lo0, (k0 + 1) / 4.0 as hi0, k1 / 5.0 as lo1, (k1 + 1) / 5.0 as hi1, n / 1000.0 as value from (select least(floor(l_discount * 40), 3)::int as k0, least(floor((l_quantity - 1) / 10), 4)::int as k1, count(*) as n from lineitem group by 1, 2))""",
    "gauss": """gauss as (select g, (g * 2 + 1) / 11.0 as c0, ((g * 3) % 5 + 0.5) / 5.0 as c1, 0.08 + g * 0.02 as sigma, n::double as mass from (select n_regionkey::bigint as g, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1))""",
    "points": "pts as (select p_partkey as q, (round(p_retailprice * 100)::bigint % 9973) / 9973.0 as x0, ((p_partkey * 31 + p_size) % 9967) / 9967.0 as x1 from part)",
    "tris": """@tiles, nodes as (select v, floor(v / 6) / 4.0 as x0, (v % 6) / 5.0 as x1 from range(30) r(v)),
corner as (select (k0 * 10 + k1 * 2 + e)::bigint as e, c, (k0 * 6 + k1 + dv)::bigint as v, value + dx as value from tiles, (values (0, 0, 0, 0.0), (0, 1, 6, 0.5), (0, 2, 1, 1.0), (1, 0, 7, 0.25), (1, 1, 1, 0.0), (1, 2, 6, 0.75)) z(e, c, dv, dx)),
wide as (select e, max(x0) filter (c = 0) as x00, max(x1) filter (c = 0) as x01, max(x0) filter (c = 1) as x10, max(x1) filter (c = 1) as x11, max(x0) filter (c = 2) as x20, max(x1) filter (c = 2) as x21, max(value) filter (c = 0) as v0, max(value) filter (c = 1) as v1, max(value) filter (c = 2) as v2 from corner join nodes using (v) group by e),
tri0 as (select *, (x10 - x00) * (x21 - x01) - (x11 - x01) * (x20 - x00) as det from wide),
tri1 as (select *, ((v1 - v0) * (x21 - x01) - (v2 - v0) * (x11 - x01)) / det as b0, ((v2 - v0) * (x10 - x00) - (v1 - v0) * (x20 - x00)) / det as b1 from tri0 where abs(det) > 1e-14),
tri as (select *, abs(det) / 2 as volume, v0 - b0 * x00 - b1 * x01 as a from tri1)""",
}


def _clip(table: str, keys: str) -> str:
    on = " and ".join(f"f.{k} = h.{k}" for k in keys.split(","))
    ks = ", ".join(f"f.{k}" for k in keys.split(","))
    names = ", ".join(keys.split(","))
    return f"""select * exclude (par, twin) from (select {names}, k, n0, n1, off, g, max(r / c) filter (c < -1e-14) as lo, min(r / c) filter (c > 1e-14) as hi, min(r) filter (abs(c) <= 1e-14) as par, coalesce(bool_or(hk > k) filter (abs(c) <= 1e-14 and abs(r) <= 1e-12 and same > 0), false) as twin
from (select {ks}, f.k, f.n0, f.n1, f.off, f.g, h.k as hk, h.n0 * f.n0 + h.n1 * f.n1 as same, h.n1 * f.n0 - h.n0 * f.n1 as c, h.off - f.off * (h.n0 * f.n0 + h.n1 * f.n1) as r from {table} f join {table} h on {on} and f.k <> h.k)
group by {names}, k, n0, n1, off, g) where (lo is null or hi is null or hi > lo) and (par is null or par >= -1e-12) and not twin"""


def _expand(sql: str, digits: int) -> str:
    import re

    while "@" in sql:
        sql = re.sub(r"@clip\((\w+)\|([\w,]+)\)", lambda m: _clip(m[1], m[2]), sql)
        sql = re.sub(r"@(?!clip)(\w+)", lambda m: PARTS[m[1]], sql)
    return re.sub(r"\$\[(.*?)\]", lambda m: f"(round(({m[1]})::double, {digits}) + 0.0)", sql, flags=re.S)


# --- transport on a line ---
def _line(spark, sf_dir):
    return T.source_intervals(roles.balance_diracs(spark, sf_dir)), T.target_intervals(roles.balance_bins(spark, sf_dir))


@query("with @diracs, @bins, @line select i, $[p] as p, $[sum(y * (x1 - x0))] as mass, $[sum(y * (x1 * x1 - x0 * x0) / 2) / sum(y * (x1 - x0))] as barycenter, $[sum(y * ((x1 - p) ** 3 - (x0 - p) ** 3) / 3)] as cost, $[2 * (p * sum(y * (x1 - x0)) - sum(y * (x1 * x1 - x0 * x0) / 2))] as grad_position from pc group by i, p")
def ot1d_barycenters(spark, sf_dir):
    return T.barycenters(T.pieces(*_line(spark, sf_dir)))


@query("with @diracs, @bins, @line select $[sum(y * ((x1 - p) ** 3 - (x0 - p) ** 3) / 3)] as cost from pc")
def ot1d_cost(spark, sf_dir):
    return T.cost(T.pieces(*_line(spark, sf_dir)))


@query("with @diracs, @bins, @line select $[sum(y * ((x1 - p) ** 3 - (x0 - p) ** 3) / 3)] as cost from pc")
def ot1d_closed_form(spark, sf_dir):
    return T.closed_form_cost(*_line(spark, sf_dir))


@query("with @diracs, @bins, @line select i, $[phi] as phi from phi")
def ot1d_weight_gradient(spark, sf_dir):
    return T.weight_gradient(T.pieces(*_line(spark, sf_dir)))


@query("with @diracs, @bins, @line select k, $[sum(((x1 - p) ** 3 - (x0 - p) ** 3) / 3 - phi * (x1 - x0))] as grad_value from pc join phi using (i) group by k", 4)
def ot1d_value_gradient(spark, sf_dir):
    parts = T.pieces(*_line(spark, sf_dir))
    return T.value_gradient(parts, T.weight_gradient(parts))


@query("""with d as (select event_type as batch, event_id as i, value / 100 as x from events),
b as (select k, k / 10.0 as lo, (k + 1) / 10.0 as hi, count(*) / (sum(count(*)) over () * (1 / 10.0)) as y from (select floor(value / 10)::int as k from events) group by k),
t as (select *, y / 10.0 as m, coalesce(sum(y / 10.0) over (order by lo rows between unbounded preceding and 1 preceding), 0) as c0, sum(y / 10.0) over (order by lo rows unbounded preceding) as c1 from b),
s as (select *, 1.0 / count(*) over (partition by batch) as w, (row_number() over (partition by batch order by x, i) - 1) / count(*) over (partition by batch)::double as w0, row_number() over (partition by batch order by x, i) / count(*) over (partition by batch)::double as w1 from d),
pc as (select batch, x as p, y, lo + (greatest(w0, c0) - c0) / y as x0, lo + (least(w1, c1) - c0) / y as x1 from s join t on w0 < c1 and c0 < w1)
select batch, $[sum(y * ((x1 - p) ** 3 - (x0 - p) ** 3) / 3)] as cost from pc group by batch""", 7)
def ot1d_batched(spark, sf_dir):
    batch = ["batch"]
    return T.cost(T.pieces(T.source_intervals(roles.order_diracs(spark, sf_dir), batch), T.target_intervals(roles.event_bins(spark, sf_dir), batch), batch), batch)


DIM = 64


def _angles(spark):
    """Four directions of the embeddings' space: (batch, n0 .. n63)."""
    n = np.cos(np.arange(1, 5)[:, None] * np.arange(1, DIM + 1)[None]) * (2 / DIM) ** 0.5
    return spark.createDataFrame([(b, *map(float, row)) for b, row in enumerate(n)], "batch long, " + ", ".join(f"n{j} double" for j in range(DIM)))


def _projection(spark, sf_dir):
    points = roles.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), *[F.col("embedding")[j].cast("double").alias(f"x{j}") for j in range(DIM)], F.lit(1.0).alias("w"))
    source = T.source_intervals(T.projected(points, _angles(spark), [f"x{j}" for j in range(DIM)]), ["batch"])
    bins = spark.range(8).select(F.col("id").cast("int").alias("k"), (F.col("id") / 4.0 - 1).alias("lo"), ((F.col("id") + 1) / 4.0 - 1).alias("hi"), (1.0 + F.col("id") % 3).alias("value"))
    target = T.target_intervals(_angles(spark).select("batch").crossJoin(F.broadcast(bins)), ["batch"])
    return T.pieces(source, target, ["batch"])


_PROJECTED = f"""with angle as (select b as batch, list_transform(range(1, {DIM + 1}), lambda j: cos((b + 1) * j) * sqrt(2.0 / {DIM})) as n from range(4) r(b)),
d as (select batch, vec_id as i, list_dot_product(embedding::double[], n) as x, n from embeddings, angle),
b as (select k, k / 4.0 - 1 as lo, (k + 1) / 4.0 - 1 as hi, (1.0 + k % 3) / sum((1.0 + k % 3) / 4.0) over () as y from range(8) r(k)),
t as (select *, coalesce(sum(y / 4.0) over (order by lo rows between unbounded preceding and 1 preceding), 0)::double as c0, (sum(y / 4.0) over (order by lo rows unbounded preceding))::double as c1 from b),
s as (select *, (row_number() over (partition by batch order by x, i) - 1) / count(*) over (partition by batch)::double as w0, row_number() over (partition by batch order by x, i) / count(*) over (partition by batch)::double as w1 from d),
pc as (select batch, i, n, x as p, y::double as y, lo + (greatest(w0, c0) - c0) / y::double as x0, lo + (least(w1, c1) - c0) / y::double as x1 from s join t on w0 < c1 and c0 < w1)
"""


@query(_PROJECTED + "select batch::bigint as batch, $[sum(y * ((x1 - p) ** 3 - (x0 - p) ** 3) / 3)] as cost from pc group by batch")
def ot1d_projected(spark, sf_dir):
    return T.cost(_projection(spark, sf_dir), ["batch"])


@query(_PROJECTED + "select i, " + ", ".join(f"$[sum(list_extract(n, {j + 1}) * 2 * y * (p * (x1 - x0) - (x1 * x1 - x0 * x0) / 2))] as g{j}" for j in range(DIM)) + " from pc group by i")
def ot1d_projected_adjoint(spark, sf_dir):
    return T.projected_adjoint(T.barycenters(_projection(spark, sf_dir), ["batch"]), _angles(spark), DIM)


# --- distributions ---
@query("select event_type as batch, count(*)::double as mass from events group by 1")
def dirac_mass(spark, sf_dir):
    return D.dirac_mass(roles.order_diracs(spark, sf_dir), ["batch"])


@query("select event_id as i, event_type as batch, $[value / 100] as x, $[1.0 / count(*) over (partition by event_type)] as w from events", 9)
def dirac_normalize(spark, sf_dir):
    return D.normalize_diracs(roles.order_diracs(spark, sf_dir), ["batch"])


@query("select event_id as i, $[value / 100] as x, 1.0::double as w from events where event_type = (select min(event_type) from events)")
def batch_slice(spark, sf_dir):
    rows = roles.order_diracs(spark, sf_dir)
    return D.batch_slice(rows, rows.agg(F.min("batch")).first()[0])


@query("with @tiles select $[sum(value * (hi0 - lo0) * (hi1 - lo1))] as mass from tiles")
def image_mass(spark, sf_dir):
    return D.grid_mass(roles.sales_tiles(spark, sf_dir), 2)


@query("with @tiles select k0, k1, $[(hi0 - lo0) * (hi1 - lo1) * 2] as grad from tiles")
def image_mass_adjoint(spark, sf_dir):
    return D.grid_mass_gradient(roles.sales_tiles(spark, sf_dir), 2, 2.0)


@query("with @tiles select k0, k1, $[value / sum(value * (hi0 - lo0) * (hi1 - lo1)) over ()] as value from tiles")
def image_normalize(spark, sf_dir):
    return D.normalize_grid(roles.sales_tiles(spark, sf_dir), 2).select("k0", "k1", "value")


@query("with @bins select k, $[coalesce(sum(value * (hi - lo)) over (order by k rows between unbounded preceding and 1 preceding), 0)] as before from b union all select max(k) + 1, $[sum(value * (hi - lo))] from b")
def image_cum_mass(spark, sf_dir):
    return D.cumulated(roles.balance_bins(spark, sf_dir))


@query("with @diracs, @bins select i, $[x] as x, $[w] as w, coalesce((select max(k) from b where lo <= x), (select min(k) from b)) as k from d")
def knot_index(spark, sf_dir):
    return D.bin_of(roles.balance_diracs(spark, sf_dir), roles.balance_bins(spark, sf_dir))


@query("with @tiles select k::bigint as k, n0::double as n0, n1::double as n1, $[case k when -1 then -min(lo0) when -2 then max(hi0) when -3 then -min(lo1) else max(hi1) end] as off from tiles, (values (-1, -1, 0), (-2, 1, 0), (-3, 0, -1), (-4, 0, 1)) v(k, n0, n1) group by k, n0, n1")
def image_support(spark, sf_dir):
    return D.grid_support(roles.sales_tiles(spark, sf_dir), 2)


@query("""with @tiles,
a as (select x.k0, x.k1, sum(exp(-0.5 * (y.k0 - x.k0) ** 2 / 0.8 ** 2) * y.value) / sum(exp(-0.5 * (y.k0 - x.k0) ** 2 / 0.8 ** 2)) as value from tiles x join tiles y on x.k1 = y.k1 and abs(x.k0 - y.k0) <= 4 group by 1, 2)
select x.k0, x.k1, $[sum(exp(-0.5 * (y.k1 - x.k1) ** 2 / 1.0 ** 2) * y.value) / sum(exp(-0.5 * (y.k1 - x.k1) ** 2 / 1.0 ** 2))] as value from a x join a y on x.k0 = y.k0 and abs(x.k1 - y.k1) <= 4 group by 1, 2""")
def image_blur(spark, sf_dir):
    return D.blur(roles.sales_tiles(spark, sf_dir), 2, [0.25, 0.2], 0.2)


@query("with @tiles select a.k0, a.k1, count(*) filter (b.value > 1.5)::bigint as upto from tiles a, tiles b where b.k0 <= a.k0 and b.k1 <= a.k1 group by 1, 2")
def summed_area(spark, sf_dir):
    return D.summed_area(roles.sales_tiles(spark, sf_dir).withColumn("value", F.col("value") - 1.5))


def _boxes(spark):
    return spark.createDataFrame([(1, 0, 0, 1, 1), (2, 1, 2, 3, 4), (3, 2, 0, 2, 4), (4, 0, 0, 3, 4)], "b int, a0 int, b0_ int, a1_ int, b1 int").select("b", F.col("a0").alias("a0"), F.col("a1_").alias("b0"), F.col("b0_").alias("a1"), F.col("b1").alias("b1"))


@query("with @tiles select b::int as b, count(*) filter (value > 0)::bigint as n from (values (1, 0, 0, 1, 1), (2, 1, 2, 3, 4), (3, 2, 0, 2, 4), (4, 0, 0, 3, 4)) v(b, a, c, e, f) join tiles on k0 between a and e and k1 between c and f group by b")
def box_count(spark, sf_dir):
    return D.box_counts(roles.sales_tiles(spark, sf_dir), _boxes(spark))


@query("""with @bins, k as (select k, floor(k / 5)::int as k0, k % 5 as k1, value from b), m as (select *, max(value) over () as most from k),
r as (select k0, k1, k1 - row_number() over (partition by k0 order by k1) as run from m where value > 0.9 * most)
select k0, min(k1)::int as a1, max(k1)::int as b1 from r group by k0, run""")
def display_blocks(spark, sf_dir):
    bins = roles.balance_bins(spark, sf_dir).where("k >= 0")
    return D.display_blocks(bins.select(F.floor(F.col("k") / 5).cast("int").alias("k0"), (F.col("k") % 5).alias("k1"), "value"), 0.9)


@query("with @gauss select g, $[c0] as c0, $[c1] as c1, $[sigma] as sigma, $[mass / sum(mass) over ()] as mass from gauss")
def gaussian_normalize(spark, sf_dir):
    return D.normalize_gaussians(roles.region_gaussians(spark, sf_dir))


@query("with @gauss select g, $[sqrt(sigma * sigma + 0.01)] as sigma from gauss")
def gaussian_convolve(spark, sf_dir):
    return D.convolve_gaussians(roles.region_gaussians(spark, sf_dir), 0.1).select("g", "sigma")


@query("with @gauss select $[min(c0 - 6 * sigma)] as lo0, $[max(c0 + 6 * sigma)] as hi0, $[min(c1 - 6 * sigma)] as lo1, $[max(c1 + 6 * sigma)] as hi1 from gauss")
def gaussian_support(spark, sf_dir):
    return D.gaussian_support(roles.region_gaussians(spark, sf_dir))


_PHI = "with @gauss, @points, u as (select *, x0 - c0 as d0, x1 - c1 as d1, exp(-((x0 - c0) ** 2 + (x1 - c1) ** 2) / (2 * sigma ** 2)) / (2 * pi() * sigma ** 2) as phi from pts, gauss) "


@query(_PHI + "select q, $[sum(mass * phi)] as value, $[sum(-mass * phi * d0 / sigma ** 2)] as grad0, $[sum(-mass * phi * d1 / sigma ** 2)] as grad1 from u group by q", 4)
def gaussian_value_gradient(spark, sf_dir):
    return D.gaussian_values(roles.sample_points(spark, sf_dir), roles.region_gaussians(spark, sf_dir))


@query(_PHI + "select g, $[sum(phi)] as by_mass, $[sum(mass * phi * d0 / sigma ** 2)] as by_c0, $[sum(mass * phi * d1 / sigma ** 2)] as by_c1, $[sum(mass * phi * ((d0 ** 2 + d1 ** 2) / sigma ** 2 - 2) / sigma)] as by_sigma from u group by g", 2)
def gaussian_parameter_gradient(spark, sf_dir):
    return D.gaussian_parameter_gradients(roles.sample_points(spark, sf_dir), roles.region_gaussians(spark, sf_dir))


def _triangles(spark, sf_dir):
    nodes, corners = roles.grid_mesh(spark, sf_dir)
    return Q.triangle_table(nodes, corners)


@query("with @tris select $[sum(volume * (v0 + v1 + v2) / 3)] as mass from tri")
def mesh_mass(spark, sf_dir):
    return D.mesh_mass(_triangles(spark, sf_dir))


@query("with @tris select e, $[volume] as volume, $[a] as a, $[b0] as b0, $[b1] as b1 from tri")
def mesh_gradients(spark, sf_dir):
    return _triangles(spark, sf_dir).select("e", "volume", "a", "b0", "b1")


@query("with @tris select $[min(x0) - 0.1 * (max(x0) - min(x0))] as lo0, $[max(x0) + 0.1 * (max(x0) - min(x0))] as hi0, $[min(x1) - 0.1 * (max(x1) - min(x1))] as lo1, $[max(x1) + 0.1 * (max(x1) - min(x1))] as hi1 from nodes")
def mesh_support(spark, sf_dir):
    return D.mesh_support(roles.grid_mesh(spark, sf_dir)[0])


_STEP = "m{n} as (select e, avg(value) as mean from {x} group by e), n{n} as (select v, sum(mean * volume / 3) / sum(volume / 3) as value from {x} join m{n} using (e) join tri using (e) group by v), c{n} as (select e, c, v, n{n}.value as value from {x} join n{n} using (v))"


@query("with @tris, " + _STEP.format(n=1, x="corner") + ", " + _STEP.format(n=2, x="c1") + ", " + _STEP.format(n=3, x="c2") + " select c2.e, c2.c, c2.v, $[0.5 * c2.value + 0.5 * c3.value] as value from c2 join c3 using (e, c)")
def corner_averages(spark, sf_dir):
    return D.corner_averages(roles.grid_mesh(spark, sf_dir)[1], _triangles(spark, sf_dir), 2.5, "iter")


# --- diagrams ---
def _seeds(spark, sf_dir):
    return roles.nation_seeds(spark, sf_dir)


def _planes(spark, sf_dir):
    return P.cell_planes(_seeds(spark, sf_dir), P.unit_box(spark, 2), 2)


def _placed(spark, sf_dir):
    return P.placed2(P.facets2(_planes(spark, sf_dir), ["i"]), _seeds(spark, sf_dir), ["i"])


@query("with @seeds, @planes select i, k::bigint as k, $[n0] as n0, $[n1] as n1, $[off] as off, $[g] as g from pl")
def power_bisectors(spark, sf_dir):
    return _planes(spark, sf_dir)


@query("with @seeds, @facets select i, k::bigint as k, $[lo] as lo, $[hi] as hi from fa where hi - lo > 1e-9")
def diagram_facets(spark, sf_dir):
    return P.facets2(_planes(spark, sf_dir), ["i"]).where("hi - lo > 1e-9").select("i", "k", "lo", "hi")


@query("with @seeds, @facets select i, k::bigint as k, $[off * n0 - lo * n1] as x0, $[off * n1 + lo * n0] as x1 from fa where hi - lo > 1e-9")
def diagram_cells(spark, sf_dir):
    return P.vertices(P.facets2(_planes(spark, sf_dir), ["i"]).where("hi - lo > 1e-9"), ["i"])


@query("with @seeds, @facets, @sums select seed.i, $[coalesce(area, 0)] as area from seed left join me using (i)", 8)
def diagram_measures(spark, sf_dir):
    return P.with_empty(_seeds(spark, sf_dir), P.measures2(_placed(spark, sf_dir), ["i"]), ["area"])


@query("with s0 as (select 1), @seeds0, @facets, @sums select seed.i, $[coalesce(area, 0)] as area from seed left join me using (i)".replace("@seeds0", PARTS["seeds"].replace("((t % 7) - 3) / 500.0 as w", "0.0 as w")), 8)
def voronoi_measures(spark, sf_dir):
    seeds = _seeds(spark, sf_dir).withColumn("w", F.lit(0.0))
    facets = P.facets2(P.cell_planes(seeds, P.unit_box(spark, 2), 2), ["i"])
    return P.with_empty(seeds, P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]), ["area"])


@query("with @seeds, @facets, @sums select i, $[area] as mass, $[m0 + p0 * area] as s0, $[m1 + p1 * area] as s1, $[q + 2 * (p0 * m0 + p1 * m1) + (p0 * p0 + p1 * p1) * area] as r2 from me", 8)
def diagram_moments(spark, sf_dir):
    return P.moments(P.measures2(_placed(spark, sf_dir), ["i"]), ["i"])


@query("with @seeds, @facets, @sums select i, k::bigint as k, $[c] as c from ed where c > 1e-9")
def hessian_rows(spark, sf_dir):
    return P.graph(_placed(spark, sf_dir)).where("c > 1e-9").select("i", "k", "c")


@query("with @seeds, @facets select i, min((lo is not null and hi is not null)::int) as is_bounded, count(*)::bigint as n_facets from fa where hi - lo > 1e-9 group by i")
def cell_is_bounded(spark, sf_dir):
    return P.bounded(P.facets2(_planes(spark, sf_dir), ["i"]).where("hi - lo > 1e-9"), ["i"])


@query("with @seeds, @points select q, arg_min(seed.i, (pts.x0 - seed.x0) ** 2 + (pts.x1 - seed.x1) ** 2 - w) as i from pts, seed group by q")
def membership(spark, sf_dir):
    return P.membership(roles.sample_points(spark, sf_dir), _seeds(spark, sf_dir).select("i", "x0", "x1", "w"))


def _values(spark, sf_dir):
    return _seeds(spark, sf_dir).select("i", (F.col("i") * F.col("i") % 7).cast("double").alias("v"))


@query("with @seeds, @facets, @sums select i, $[sum(c * (i * i % 7 - k * k % 7))] as grad from ed group by i")
def measure_vjp_weights(spark, sf_dir):
    return P.vjp_weights(P.graph(_placed(spark, sf_dir)), _values(spark, sf_dir))


@query("with @seeds, @facets, @sums select i, $[sum(2 * c * (i * i % 7 - k * k % 7) * (e0 - x0))] as grad0, $[sum(2 * c * (i * i % 7 - k * k % 7) * (e1 - x1))] as grad1 from ed join seed using (i) group by i")
def measure_vjp_positions(spark, sf_dir):
    return P.vjp_positions(P.graph(_placed(spark, sf_dir)), _values(spark, sf_dir), _seeds(spark, sf_dir))


@query("""with @seeds,
box as (select -1 - 2 * a - s as k, case when a = 0 then 2 * s - 1 else 0 end as n0, case when a = 1 then 2 * s - 1 else 0 end as n1, case when a = 2 then 2 * s - 1 else 0 end as n2, s as off from range(3) x(a), range(2) y(s)),
bis as (select p.i, q.i as k, q.x0 - p.x0 as d0, q.x1 - p.x1 as d1, q.x2 - p.x2 as d2, sqrt((q.x0 - p.x0) ** 2 + (q.x1 - p.x1) ** 2 + (q.x2 - p.x2) ** 2) as g, (q.x0 ** 2 + q.x1 ** 2 + q.x2 ** 2 - p.x0 ** 2 - p.x1 ** 2 - p.x2 ** 2 + p.w - q.w) / 2 as o from seed p join seed q on p.i <> q.i),
pl as (select i, k, d0 / g as n0, d1 / g as n1, d2 / g as n2, o / g as off from bis union all select seed.i, box.k, n0, n1, n2, off from seed, box),
pr as (select f.i, f.k, s.k as j, f.n0 as f0, f.n1 as f1, f.n2 as f2, f.off as fo, s.n0 as s0, s.n1 as s1, s.n2 as s2, s.off as so, f.n1 * s.n2 - f.n2 * s.n1 as u0, f.n2 * s.n0 - f.n0 * s.n2 as u1, f.n0 * s.n1 - f.n1 * s.n0 as u2, f.n0 * s.n0 + f.n1 * s.n1 + f.n2 * s.n2 as co from pl f join pl s on f.i = s.i and f.k <> s.k),
pd as (select *, sqrt(u0 ** 2 + u1 ** 2 + u2 ** 2) as u from pr),
po as (select *, u0 / u as d0, u1 / u as d1, u2 / u as d2, ((fo - so * co) * f0 + (so - fo * co) * s0) / u ** 2 as o0, ((fo - so * co) * f1 + (so - fo * co) * s1) / u ** 2 as o1, ((fo - so * co) * f2 + (so - fo * co) * s2) / u ** 2 as o2 from pd where u > 1e-12),
cl as (select p.*, h.n0 * d0 + h.n1 * d1 + h.n2 * d2 as c, h.off - (h.n0 * o0 + h.n1 * o1 + h.n2 * o2) as r from po p join pl h on p.i = h.i and h.k <> p.k and h.k <> p.j),
eg as (select i, k, j, f0, f1, f2, fo, s0, s1, s2, co, u, o0, o1, o2, max(r / c) filter (c < -1e-12) as lo, min(r / c) filter (c > 1e-12) as hi, min(r) filter (abs(c) <= 1e-12) as par from cl group by all),
fa as (select i, k, fo - (f0 * x0 + f1 * x1 + f2 * x2) as h, sum((hi - lo) / 2 * ((o0 - x0 - (fo - (f0 * x0 + f1 * x1 + f2 * x2)) * f0) * (s0 - co * f0) + (o1 - x1 - (fo - (f0 * x0 + f1 * x1 + f2 * x2)) * f1) * (s1 - co * f1) + (o2 - x2 - (fo - (f0 * x0 + f1 * x1 + f2 * x2)) * f2) * (s2 - co * f2)) / u) as area from eg join seed using (i) where hi > lo and (par is null or par >= -1e-13) group by 1, 2, 3)
select i, $[sum(h * area / 3)] as volume from fa group by i""", 8)
def diagram3d_measures(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    return P.measures3(P.facets3(P.edges3(P.cell_planes(seeds, P.unit_box(spark, 3), 3), ["i"]), seeds))


# --- densities over cells ---
_CUT = "pc as (@clip(cut|i,z)), ms as (select i, z, sum(off * (hi - lo) / 2) as mass, sum(off / 3 * (off * n0 * (hi - lo) - n1 * (hi ** 2 - lo ** 2) / 2)) as s0, sum(off / 3 * (off * n1 * (hi - lo) + n0 * (hi ** 2 - lo ** 2) / 2)) as s1, sum(off / 4 * (off * off * (hi - lo) + (hi ** 3 - lo ** 3) / 3)) as r2 from pc group by i, z)"


@query("with @seeds, @planes, @tiles, t as (select k0 * 100 + k1 as z, * from tiles), cut as (select pl.i, z, pl.k, pl.n0, pl.n1, pl.off, pl.g from pl, t union all select seed.i, z, s.k, s.n0::double, s.n1::double, case s.k when -101 then -lo0 when -102 then hi0 when -103 then -lo1 else hi1 end::double, null from seed, t, (values (-101, -1, 0), (-102, 1, 0), (-103, 0, -1), (-104, 0, 1)) s(k, n0, n1)), " + _CUT + " select i, $[sum(value * mass)] as mass, $[sum(value * s0)] as s0, $[sum(value * s1)] as s1, $[sum(value * r2)] as r2 from ms join t using (z) group by i")
def grid_density_moments(spark, sf_dir):
    return Q.grid_moments(_planes(spark, sf_dir), roles.sales_tiles(spark, sf_dir))


@query("with @seeds, @planes, w as (select * from (values (-11, 0.0, -1.0, -0.1), (-12, 0.8, 0.6, 0.9), (-13, -1.0, 0.0, -0.05)) v(k, n0, n1, off)), cut as (select *, 0 as z from pl union all select i, k, n0::double, n1::double, off::double, null, 0 from seed, w), " + _CUT + " select i, $[2.5 * mass] as mass, $[2.5 * s0] as s0, $[2.5 * s1] as s1, $[2.5 * r2] as r2 from ms")
def polytope_density_moments(spark, sf_dir):
    walls = spark.createDataFrame([(-11, 0.0, -1.0, -0.1), (-12, 0.8, 0.6, 0.9), (-13, -1.0, 0.0, -0.05)], "k long, n0 double, n1 double, off double")
    return Q.polytope_moments(_planes(spark, sf_dir), walls, 2.5)


@query("with @seeds, @planes, @tris, wl as (select e as z, sd.k, sign(det) * (qy - ay) / l as n0, -sign(det) * (qx - ax) / l as n1, ax, ay from (select *, sqrt((qx - ax) ** 2 + (qy - ay) ** 2) as l from (select e, det, -101 as k, x00 as ax, x01 as ay, x10 as qx, x11 as qy from tri union all select e, det, -102, x10, x11, x20, x21 from tri union all select e, det, -103, x20, x21, x00, x01 from tri)) sd), cut as (select pl.i, e as z, pl.k, pl.n0, pl.n1, pl.off, pl.g from pl, tri union all select i, z, k, n0, n1, n0 * ax + n1 * ay, null from seed, wl), " + _CUT + " select i, $[sum(a * mass + b0 * s0 + b1 * s1)] as mass from ms join tri on z = e group by i")
def mesh_density_masses(spark, sf_dir):
    return Q.mesh_masses(_planes(spark, sf_dir), *roles.grid_mesh(spark, sf_dir))


_GL = "gl as (select * from (values " + ", ".join(f"({u!r}::double, {w!r}::double)" for u, w in gauss_legendre(Q.NODES)) + ") v(u, wt))"


@query("with @seeds, @facets, @gauss, " + _GL + ", y as (select fa.*, gauss.*, off - n0 * c0 - n1 * c1 as h, n0 * c1 - n1 * c0 as foot from fa, gauss), a as (select *, atan((lo - foot) / abs(h)) as a0, atan((hi - foot) / abs(h)) as a1 from y where abs(h) > 1e-14) select i, $[sum(mass * sign(h) * (a1 - a0) * wt * (1 - exp(-h * h / (2 * sigma ** 2 * cos(a0 + (a1 - a0) * u) ** 2))) / (2 * pi()))] as mass from a, gl group by i")
def gaussian_density_masses(spark, sf_dir):
    return Q.gaussian_masses(P.facets2(_planes(spark, sf_dir), ["i"]), roles.region_gaussians(spark, sf_dir))


@query("with @seeds, @facets, @sums select i, k::bigint as k, $[h * (t1 - t0) / 2] as area, $[off * n0 - lo * n1] as x10, $[off * n1 + lo * n0] as x11 from pf where hi - lo > 1e-9")
def cell_simplices(spark, sf_dir):
    return P.simplices(_placed(spark, sf_dir).where("hi - lo > 1e-9"), ["i"]).select("i", "k", "area", "x10", "x11")


@query("""with @seeds, @facets, v as (select i, k, off * n0 - lo * n1 as x, off * n1 + lo * n0 as y, off * n0 - hi * n1 as u, off * n1 + hi * n0 as w from fa where hi - lo > 1e-9),
p as (select b.i, b.k, arg_min(struct_pack(x := a.x, y := a.y), (a.u - b.x) ** 2 + (a.w - b.y) ** 2) as before, any_value(b.u) as u, any_value(b.w) as w from v b join v a on a.i = b.i and a.k <> b.k group by b.i, b.k)
select i, k::bigint as k, $[(w - before.y) / 2] as grad0, $[(before.x - u) / 2] as grad1 from p""", 5)
def measure_vertex_gradient(spark, sf_dir):
    return P.vertex_gradient(P.facets2(_planes(spark, sf_dir), ["i"]).where("hi - lo > 1e-9"), ["i"])


@query("with @seeds, @facets, @tris, wl as (select e, sign(det) * (qy - ay) / l as h0, -sign(det) * (qx - ax) / l as h1, ax, ay from (select *, sqrt((qx - ax) ** 2 + (qy - ay) ** 2) as l from (select e, det, x00 as ax, x01 as ay, x10 as qx, x11 as qy from tri union all select e, det, x10, x11, x20, x21 from tri union all select e, det, x20, x21, x00, x01 from tri))), cr as (select fa.i, fa.k, wl.e, fa.n0, fa.n1, fa.off, lo, hi, h1 * n0 - h0 * n1 as c, h0 * ax + h1 * ay - off * (h0 * n0 + h1 * n1) as r from fa, wl where fa.k >= 0), cp as (select i, k, e, n0, n1, off, greatest(lo, max(r / c) filter (c < -1e-14)) as a, least(hi, min(r / c) filter (c > 1e-14)) as b, min(r) filter (abs(c) <= 1e-14) as par from cr group by i, k, e, n0, n1, off, lo, hi) select i, cp.k::bigint as k, $[sum((cp.b - cp.a) * (tri.a + b0 * (off * n0 - (cp.a + cp.b) / 2 * n1) + b1 * (off * n1 + (cp.a + cp.b) / 2 * n0)))] as mass from cp join tri using (e) where cp.b > cp.a and coalesce(par, 1) > 0 group by i, cp.k", 5)
def mesh_facet_masses(spark, sf_dir):
    return Q.mesh_facet_masses(P.facets2(_planes(spark, sf_dir), ["i"]), *roles.grid_mesh(spark, sf_dir))


@query("with @seeds, @facets, @gauss, " + _GL + " select i, k::bigint as k, $[sum((hi - lo) * wt * mass * exp(-((off * n0 - (lo + (hi - lo) * u) * n1 - c0) ** 2 + (off * n1 + (lo + (hi - lo) * u) * n0 - c1) ** 2) / (2 * sigma ** 2)) / (2 * pi() * sigma ** 2))] as mass from fa, gauss, gl where k >= 0 group by i, k", 5)
def gaussian_facet_masses(spark, sf_dir):
    return Q.gaussian_facet_masses(P.facets2(_planes(spark, sf_dir), ["i"]), roles.region_gaussians(spark, sf_dir))


# --- candidates ---
_SUPPLIER = "sup as (select s_suppkey as i, (s_acctbal + 1000) / 11000 as x0, ((s_suppkey * 7919) % 10007 + 0.5) / 10007.0 as x1 from supplier), bu as (select *, least(greatest(floor(x0 * 8), 0), 7)::int as b0, least(greatest(floor(x1 * 8), 0), 7)::int as b1 from sup)"


@query("with " + _SUPPLIER + " select b0, b1, count(*)::bigint as n, $[min(x0)] as lo0, $[max(x0)] as hi0, $[min(x1)] as lo1, $[max(x1)] as hi1, 0.0::double as top from bu group by b0, b1")
def weight_majorants(spark, sf_dir):
    return I.majorants(roles.supplier_seeds(spark, sf_dir), 8)


@query("with " + _SUPPLIER + " select i, (row_number() over (order by b0, b1, i) - 1)::bigint as rank from bu")
def seed_ranks(spark, sf_dir):
    return I.ranks(roles.supplier_seeds(spark, sf_dir), 8)


@query("with z as (select c_custkey as i, floor(c_acctbal / 100)::bigint as x0, c_nationkey as x1 from customer), r as (select *, min(i) over (partition by x0, x1) as rep from z) select i as dup, rep from r where i <> rep")
def duplicate_seeds(spark, sf_dir):
    rows = roles.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.floor(F.col("c_acctbal") / 100).alias("x0"), F.col("c_nationkey").alias("x1"))
    return I.duplicates(rows)


@query("with a as (select s_suppkey as id, (s_acctbal + 1000) / 11000 as l0, ((s_suppkey * 7919) % 10007) / 10007.0 as l1 from supplier), b as (select p_partkey as id, (p_partkey * 613 % 9973) / 9973.0 as l0, (p_partkey * 31 % 9967) / 9967.0 as l1 from part) select a.id as a, b.id as b from a join b on a.l0 <= b.l0 + 0.05 and b.l0 <= a.l0 + 0.1 and a.l1 <= b.l1 + 0.05 and b.l1 <= a.l1 + 0.08")
def overlapping_boxes(spark, sf_dir):
    s, p = roles.read(spark, sf_dir, "supplier"), roles.read(spark, sf_dir, "part")
    boxes = lambda df, i, l0, l1, w0, w1: df.select(i.alias("id"), l0.alias("lo0"), (l0 + w0).alias("hi0"), l1.alias("lo1"), (l1 + w1).alias("hi1"))
    a = boxes(s, F.col("s_suppkey"), (F.col("s_acctbal") + 1000) / 11000, F.pmod(F.col("s_suppkey") * 7919, F.lit(10007)) / 10007.0, 0.1, 0.08)
    b = boxes(p, F.col("p_partkey"), F.pmod(F.col("p_partkey") * 613, F.lit(9973)) / 9973.0, F.pmod(F.col("p_partkey") * 31, F.lit(9967)) / 9967.0, 0.05, 0.05)
    return I.overlapping_pairs(a, b)


@query("with " + _SUPPLIER.replace("sup as", "seed as").replace("from sup)", "from seed)").replace(" as x1 from supplier)", " as x1, 0.0 as w from supplier)") + ", @facets, @sums select seed.i, $[coalesce(area, 0)] as area from seed left join me using (i)", 9)
def pruned_measures(spark, sf_dir):
    seeds = roles.supplier_seeds(spark, sf_dir)
    n = seeds.count()
    facets = I.pruned_facets(seeds, P.unit_box(spark, 2), max(1, int((n / 3) ** 0.5)))
    return P.with_empty(seeds, P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]), ["area"])


# --- tensor algebra ---
def _matrix(spark, sf_dir):
    """[returnflag, linenumber]: quantities in thousands."""
    return roles.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("l")).agg((F.sum("l_quantity") / 1000).alias("v"))


_MATRIX = "m as (select l_returnflag as r, l_linenumber as l, sum(l_quantity) / 1000 as v from lineitem group by 1, 2)"


@query("with " + _MATRIX + " select m.r, m.l, $[m.v + s.v] as v from m join (select l, sum(v) as v from m group by l) s using (l)")
def tensor_add(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return A.add(m, A.reduce(m, "sum", ["r"]))


@query("with " + _MATRIX + " select a.r, b.r as r2, $[sum(a.v * b.v)] as v from m a join m b using (l) group by 1, 2", 3)
def tensor_contract(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return A.dot(m, m.withColumnRenamed("r", "r2"), ["l"])


@query("with " + _MATRIX + ", a as (select r, max(v) as v from m group by r), b as (select l, min(v) as v from m group by l) select r, l, $[a.v * b.v] as v from a, b")
def tensor_outer(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return A.mul(A.reduce(m, "max", ["l"]), A.reduce(m, "min", ["r"]))


@query("with " + _MATRIX + " select m.r, m.l, $[case when m.v < s.v then sqrt(m.v) else least(greatest(m.v, 1), 5) end] as v from m join (select r, avg(v) as v from m group by r) s using (r)")
def tensor_where(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return A.where(A.less(m, A.reduce(m, "mean", ["l"])), A.apply(m, A.FUNCTIONS["sqrt"]), A.clip(m, 1.0, 5.0))


@query("with " + _MATRIX + " select l - 2 as l, $[product(asin(v / 1000000)) * 1e9] as v from m where r = 'R' and l >= 2 and l < 6 group by l")
def tensor_slice(spark, sf_dir):
    m = A.window(A.index(_matrix(spark, sf_dir), r="R"), "l", 2, 6)
    return A.apply(A.apply(A.apply(m, lambda v: v / 1000000), A.FUNCTIONS["arcsin"]), lambda v: v * 1e9)


# --- solves ---
@query("with @seeds select i, $[1.0 / count(*) over ()] as mass, $[1.0 / count(*) over ()] as target_mass from seed")
def newton_masses(spark, sf_dir):
    """Cell masses of the solved plan are the target masses."""
    import pyarrow as pa

    from .plans.problem import Box, SumOfDiracs, ot_solve

    seeds = _seeds(spark, sf_dir).select("i", "x0", "x1").orderBy("i").toPandas()
    plan = ot_solve(SumOfDiracs(seeds[["x0", "x1"]].to_numpy()), Box([0, 0], [1, 1]), tol=1e-10)
    return spark.createDataFrame(pa.table({"i": seeds["i"].to_numpy(), "mass": plan.cell_masses, "target_mass": plan.target_masses}))


def _solved(spark, seeds, target, d=2, **settings):
    """Cell masses of the solved plan beside the target masses."""
    import pyarrow as pa

    from .plans.problem import SumOfDiracs, ot_solve

    rows = seeds.select("i", *[f"x{a}" for a in range(d)]).orderBy("i").toPandas()  # the solve's vectors are the driver's
    plan = ot_solve(SumOfDiracs(rows[[f"x{a}" for a in range(d)]].to_numpy()), target, spark, **settings)
    return spark.createDataFrame(pa.table({"i": rows["i"].to_numpy(), "mass": plan.cell_masses, "target_mass": plan.target_masses}))


@query("select s_suppkey as i, $[1.0 / count(*) over ()] as mass, $[1.0 / count(*) over ()] as target_mass from supplier")
def newton_supplier_masses(spark, sf_dir):
    """One seed a supplier; the sweeps run on the executors."""
    from .plans.problem import Box

    return _solved(spark, roles.supplier_seeds(spark, sf_dir), Box([0, 0], [1, 1]), tol=1e-9)


@query("with @seeds select i, $[1.0 / count(*) over ()] as mass, $[1.0 / count(*) over ()] as target_mass from seed")
def newton_solid_masses(spark, sf_dir):
    """The same in three dimensions."""
    from .plans.problem import Box

    return _solved(spark, _seeds(spark, sf_dir), Box([0, 0, 0], [1, 1, 1]), 3, tol=1e-9)


@query("with @seeds select i, $[1.0 / count(*) over ()] as mass, $[1.0 / count(*) over ()] as target_mass from seed")
def newton_mesh_masses(spark, sf_dir):
    """To a density that is affine on triangles."""
    from .plans.problem import Mesh

    nodes, corners = (t.toPandas() for t in roles.grid_mesh(spark, sf_dir))  # 30 nodes, 40 triangles
    nodes, corners = nodes.sort_values("v"), corners.sort_values(["e", "c"])
    mesh = Mesh(nodes[["x0", "x1"]].to_numpy(), corners["v"].to_numpy().reshape(-1, 3), corners["value"].to_numpy().reshape(-1, 3))
    return _solved(spark, _seeds(spark, sf_dir), mesh, tol=1e-9)


@query("with @seeds select i, $[(i * i % 7) - avg(i * i % 7) over ()] as product from seed")
def laplacian_solve(spark, sf_dir):
    """L x for the solution x of L x = rhs: rhs less its mean, on a diagram without empty cells."""
    import pyarrow as pa

    from .plans.problem import laplacian_solve as solve

    seeds = _seeds(spark, sf_dir).withColumn("w", F.lit(0.0))
    edges = P.graph(P.placed2(P.facets2(P.cell_planes(seeds, P.unit_box(spark, 2), 2), ["i"]), seeds, ["i"])).select("i", "k", "c")
    ids = np.array(sorted(r["i"] for r in seeds.select("i").collect()))
    e = edges.toPandas()
    x = solve(len(ids), np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["k"]), e["c"].to_numpy(), (ids * ids % 7).astype(float))
    values = spark.createDataFrame(pa.table({"i": ids, "v": x}))
    return P.vjp_weights(edges, values).withColumnRenamed("grad", "product")


@query("with @diracs, @bins, @line select i, $[sum(y * (x1 * x1 - x0 * x0) / 2) / sum(y * (x1 - x0))] as x from pc group by i")
def lloyd_step(spark, sf_dir):
    from .plans.quantize import lloyd_1d

    return lloyd_1d(roles.balance_diracs(spark, sf_dir), roles.balance_bins(spark, sf_dir), 1).select("i", "x")


@query("with @tiles select 16::bigint as n_points, $[1.0] as mass, true as inside, true as stationary, $[sum(value * (hi0 - lo0) * (hi1 - lo1))] as target_mass from tiles")
def quantization(spark, sf_dir):
    """Sixteen points that quantize the sales grid: they hold all its mass, and moving to their cells' barycenters would save nothing."""
    import pyarrow as pa

    from .plans.problem import Image, Iterative, OtProblem, SumOfDiracs
    from .plans.quantize import quantization as lloyd

    tiles = roles.sales_tiles(spark, sf_dir).toPandas()  # a grid of 4 x 5
    values = np.zeros((4, 5))
    values[tiles["k0"], tiles["k1"]] = tiles["value"]
    grid, start = Image(values, [0, 0], [1, 1]), np.stack(np.meshgrid(np.arange(4) / 4 + 0.1, np.arange(4) / 4 + 0.13), -1).reshape(-1, 2)
    x = lloyd(grid, start, tol=5e-2, spark=spark)
    plan = OtProblem(SumOfDiracs(x), grid, spark).solve(Iterative(tol=1e-6))
    saved = (plan.cell_masses * ((plan.barycenters - x) ** 2).sum(1)).sum() / plan.cost
    inside, stationary = bool(((x > 0) & (x < 1)).all()), bool(saved <= 5e-2**2)
    return spark.createDataFrame(pa.table({"n_points": [len(x)], "mass": [float(plan.cell_masses.sum())], "inside": [inside], "stationary": [stationary], "target_mass": [grid.mass]}))
