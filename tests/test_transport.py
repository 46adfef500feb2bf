import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import diagram as P
from tilewright.operators import distributions as D
from tilewright.operators import spatial as I
from tilewright.operators import transport1d as T
from tilewright.plans import multilevel, sweep, sweep3
from tilewright.plans.problem import BlackBox, Box, Direct, Image, Iterative, Mesh, OtNotConverged, OtProblem, Polygon, SumOfDiracs, SumOfGaussians, laplacian_solve, mass_derivative_of_weights, near_rows, ot_solve, position_derivative_of_weights, residual, w2
from tilewright.plans.quantize import lloyd_1d, quantization, uniform_in_support
from tilewright.plans.sweep import GridDensity, Pointwise, Sweeper, Uniform, box_ring, cells


def line(spark, x, values, w=None):
    diracs = spark.createDataFrame([(i, float(v), 1.0 if w is None else float(w[i])) for i, v in enumerate(x)], "i long, x double, w double")
    bins = spark.createDataFrame([(k, float(k), k + 1.0, float(v)) for k, v in enumerate(values)], "k int, lo double, hi double, value double")
    return diracs, bins


def solve(spark, x, values, w=None):
    d, b = line(spark, x, values, w)
    return T.pieces(T.source_intervals(d), T.target_intervals(b))


def cost(spark, x, values, w=None):
    return T.cost(solve(spark, x, values, w)).first()["cost"]


@pytest.mark.parametrize(("x", "values", "want"), [([0.5], [1], 1 / 12), ([1.0], [1, 1], 1 / 3)])
def test_known_costs(spark, x, values, want):
    assert cost(spark, x, values) == pytest.approx(want, abs=1e-12)
    d, b = line(spark, x, values)
    assert T.closed_form_cost(T.source_intervals(d), T.target_intervals(b)).first()["cost"] == pytest.approx(want, abs=1e-12)


def test_barycenter_and_order(spark):
    assert T.barycenters(solve(spark, [0.5], [1])).first()["barycenter"] == pytest.approx(0.5)
    x = np.random.default_rng(0).uniform(0, 5, 10)
    assert cost(spark, x, [1, 2, 0, 3, 1]) == pytest.approx(cost(spark, x[::-1], [1, 2, 0, 3, 1]), abs=1e-12)


def test_position_gradient_by_differences(spark):
    x, e = np.array([0.2, 0.5, 0.9]), 1e-5
    rows = {r["i"]: r["grad_position"] for r in T.barycenters(solve(spark, x, [1, 0, 1])).collect()}
    for i in range(3):
        d = np.eye(3)[i] * e
        assert rows[i] == pytest.approx((cost(spark, x + d, [1, 0, 1]) - cost(spark, x - d, [1, 0, 1])) / (2 * e), abs=1e-6)


def test_zero_density_ends(spark):
    x = [0.3, 1.1, 2.2, 3.9]
    assert cost(spark, x, [0, 0, 1, 2, 1]) == pytest.approx(cost(spark, np.array(x) - 2, [1, 2, 1]), abs=1e-12)


def test_bisectors_and_weight_gap(spark):
    for gap in (0.0, 0.1):
        seeds = spark.createDataFrame([(0, 0.25, 0.5, gap), (1, 0.75, 0.5, 0.0)], "i long, x0 double, x1 double, w double")
        facets = P.facets2(P.cell_planes(seeds, P.unit_box(spark, 2), 2), ["i"])
        area = {r["i"]: r["area"] for r in P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]).collect()}
        assert area[0] == pytest.approx(0.5 + gap)
        assert sum(area.values()) == pytest.approx(1)


def test_relational_and_vectorised_cells_agree(spark):
    rng = np.random.default_rng(3)
    x, w = rng.uniform(size=(30, 2)), 0.01 * rng.normal(size=30)
    seeds = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, w, strict=True))], "i long, x0 double, x1 double, w double")
    full = P.facets2(P.cell_planes(seeds, P.unit_box(spark, 2), 2), ["i"])
    pruned = I.pruned_facets(seeds, P.unit_box(spark, 2), 5)
    ring, ids = box_ring()
    want = cells(x, w, np.arange(30), ring, ids).moments()
    for facets in (full, pruned):
        got = {r["i"]: (r["mass"], r["s0"], r["s1"], r["r2"]) for r in P.moments(P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]), ["i"]).collect()}
        for i in range(30):
            assert got.get(i, (0, 0, 0, 0)) == pytest.approx(tuple(want[i]), abs=1e-10)


def test_pruning_across_a_gap_looks_at_few_planes(spark, monkeypatch):
    """Cells beside an empty stretch reach to the border until the seeds behind it cut them."""
    rng = np.random.default_rng(8)
    x = rng.uniform(size=(600, 2)) * [0.2, 1.0]
    x[300:, 0] += 0.8
    seeds = spark.createDataFrame([(i, *map(float, p), 0.0) for i, p in enumerate(x)], "i long, x0 double, x1 double, w double")
    facets2, planes = I.facets2, []
    monkeypatch.setattr(I, "facets2", lambda rows, keys: planes.append(rows.count()) or facets2(rows, keys))
    facets = I.pruned_facets(seeds, P.unit_box(spark, 2), 14)
    assert sum(planes) <= 12 * len(x)
    got = {r["i"]: r["area"] for r in P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(cells(x, np.zeros(len(x)), np.arange(len(x)), *box_ring()).moments()[:, 0], abs=1e-12)


def test_long_cells_are_cut_by_the_nearest_stacks_first(monkeypatch):
    """Seeds in low stacks far apart: cells reach over all others before the next stacks cut them."""
    rng, looked = np.random.default_rng(10), []
    x = np.repeat(rng.uniform(0.02, 0.98, (60, 2)), 40, 0) + np.tile(np.arange(40) * 1e-4, 60)[:, None] * [0, 1]
    cut = sweep._cut_by
    monkeypatch.setattr(sweep, "_cut_by", lambda *a: looked.append(len(a[4])) or cut(*a))
    at_once = cells(x, np.zeros(len(x)), np.arange(len(x)), *box_ring()).moments()
    before = sum(looked)
    widening = cells(x, np.zeros(len(x)), np.arange(len(x)), *box_ring(), widening=True).moments()
    assert widening == pytest.approx(at_once, abs=1e-12)
    assert 2 * (sum(looked) - before) < before


def test_pruned_facets_are_those_of_all_pairs(spark):
    """Seeds at one place, with equal and other weights, empty cells, seeds without a place, other domains."""
    rng = np.random.default_rng(9)
    x, w = rng.uniform(size=(40, 2)), 0.03 * rng.normal(size=40)
    x[30:36], w[30:33] = x[:6], w[:3]
    rows = [(7 * i + 3, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, w, strict=True))]
    schema = "i long, x0 double, x1 double, w double"
    triangle = spark.createDataFrame([(-1, 0.0, -1.0, 0.0), (-2, -1.0, 0.0, 0.0), (-3, 0.5**0.5, 0.5**0.5, 0.8), (-4, 1.0, 0.0, 5.0)], "k long, n0 double, n1 double, off double")
    end = lambda v: v if v is None else pytest.approx(v, abs=1e-9)
    for domain, some in ((P.unit_box(spark, 2), [*rows, (1000, None, 0.5, 0.0)]), (triangle, rows), (triangle, rows[:1]), (triangle, [])):
        seeds = spark.createDataFrame(some, schema)
        want = {(r["i"], r["k"]): (r["lo"], r["hi"]) for r in P.facets2(P.cell_planes(seeds, domain, 2), ["i"]).collect()}
        got = {(r["i"], r["k"]): (r["lo"], r["hi"]) for r in I.pruned_facets(seeds, domain, 4).collect()}
        assert got.keys() == want.keys()
        assert all(got[f] == (end(a), end(b)) for f, (a, b) in want.items())


def test_cells_tile_and_match_membership():
    rng = np.random.default_rng(4)
    x, w = rng.uniform(size=(60, 2)), 0.02 * rng.normal(size=60)
    ring, ids = box_ring()
    area = cells(x, w, np.arange(60), ring, ids).moments()[:, 0]
    assert area.sum() == pytest.approx(1, abs=1e-12)
    q = rng.uniform(size=(100_000, 2))
    own = (((q[:, None] - x[None]) ** 2).sum(2) - w).argmin(1)
    assert np.abs(np.bincount(own, minlength=60) / len(q) - area).max() < 5e-3


def test_grid_of_seeds_duplicates_and_densities():
    g = np.stack(np.meshgrid(*[np.arange(3) / 3 + 1 / 6] * 2), -1).reshape(-1, 2)
    ring, ids = box_ring()
    polygons = cells(g, np.zeros(9), np.arange(9), ring, ids)
    assert polygons.moments()[:, 0] == pytest.approx(np.full(9, 1 / 9))
    twice = cells(np.concatenate([g, g]), np.zeros(18), np.arange(18), ring, ids)
    assert twice.moments()[:, 0].sum() == pytest.approx(1) and (twice.n == 0).sum() == 9
    flat, _ = Uniform().integrate(polygons)
    assert GridDensity(np.ones((7, 5))).integrate(polygons)[0] == pytest.approx(flat, abs=1e-12)
    assert Pointwise(lambda y: 1 + y[:, 0] * y[:, 1], 0.2).integrate(polygons)[0][:, 0].sum() == pytest.approx(1.25)


def test_three_dimensions(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(8, 3))
    seeds = spark.createDataFrame([(i, *map(float, p), 0.0) for i, p in enumerate(x)], "i long, x0 double, x1 double, x2 double, w double")
    got = P.measures3(P.facets3(P.edges3(P.cell_planes(seeds, P.unit_box(spark, 3), 3), ["i"]), seeds)).collect()
    assert sum(r["volume"] for r in got) == pytest.approx(1, abs=1e-10)


def test_unbounded_cells(spark):
    seeds = spark.createDataFrame([(0, 0.25, 0.5, 0.0), (1, 0.75, 0.5, 0.0), (2, 0.5, 0.9, 0.0)], "i long, x0 double, x1 double, w double")
    facets = P.facets2(P.bisectors(seeds, 2), ["i"])
    assert {r["is_bounded"] for r in P.bounded(facets, ["i"]).collect()} == {0}
    assert {r["area"] for r in P.measures2(P.placed2(facets, seeds, ["i"]), ["i"]).collect()} == {P.UNBOUNDED}


def test_newton_reaches_masses_and_gradients():
    rng = np.random.default_rng(1)
    x, box = rng.uniform(size=(20, 2)), Box([0, 0], [1, 1])
    plan = ot_solve(SumOfDiracs(x), box, tol=1e-10)
    assert np.abs(residual(plan)).max() < 1e-10 and plan.stats["iterations"] <= 8
    e, d = 1e-5, np.zeros_like(x)
    d[3, 0] = 1
    up, down = (ot_solve(SumOfDiracs(x + s * e * d), box, tol=1e-12) for s in (1, -1))
    assert plan.position_gradient()[3, 0] == pytest.approx((up.cost - down.cost) / (2 * e), abs=1e-7)
    assert np.abs((up.weights - down.weights) / (2 * e) - position_derivative_of_weights(plan, d)).max() < 1e-6


def test_other_targets_and_continuation(spark):
    x = np.random.default_rng(2).uniform(size=(20, 2))
    for target in (SumOfGaussians([[0.5, 0.5]], [0.15], support_box=([0, 0], [1, 1])), Image(np.arange(1, 10).reshape(3, 3), [0, 0], [1, 1]), Polygon([[0, 0], [1, 0], [0.4, 1]]), BlackBox(lambda y: 1 + y[:, 0] - 0.5)):
        assert np.abs(residual(ot_solve(SumOfDiracs(x), target, tol=1e-6))).max() < 1e-5
    hard = Image(np.pad(np.ones((2, 2)), ((0, 6), (0, 6))) + 1e-9, [0, 0], [1, 1])
    assert ot_solve(SumOfDiracs(x * 0.5 + 0.5), hard, tol=1e-7).converged
    assert ot_solve(SumOfDiracs(x), Box([0, 0], [1, 1]), spark, tol=1e-9).converged


def test_spark_sweep_is_the_local_sweep(spark):
    x = np.random.default_rng(6).uniform(size=(3000, 2))
    w = np.zeros(3000)
    a, b = Sweeper(x, Uniform())(w), Sweeper(x, Uniform(), spark=spark)(w)
    assert np.array_equal(a.moments, b.moments)
    assert np.array_equal(np.sort(a.c), np.sort(b.c))


def test_errors_duplicates_and_warm_start():
    box, x = Box([0, 0], [1, 1]), np.random.default_rng(7).uniform(size=(12, 2))
    with pytest.raises(TypeError):
        OtProblem(SumOfDiracs(x), box).solve(Direct())
    with pytest.raises(TypeError):
        ot_solve(SumOfDiracs(x), box, nonsense=1)
    with pytest.raises(ValueError):
        ot_solve(SumOfDiracs(x), box, weights0=np.zeros(3))
    with pytest.raises(ValueError):
        Iterative(on_failure="never")
    with pytest.raises(OtNotConverged) as caught:
        ot_solve(SumOfDiracs(x), box, max_iter=1, tol=1e-15)
    assert caught.value.solution.cell_masses.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        Polygon([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    twice = ot_solve(SumOfDiracs(np.concatenate([x, x])), box, tol=1e-9)
    assert twice.stats["status"] == "converged (aggregated)" and twice.cell_masses == pytest.approx(np.full(24, 1 / 24))
    problem = OtProblem(SumOfDiracs(x), box)
    problem.solve(Iterative(tol=1e-9))
    problem.source = SumOfDiracs(x + 1e-4)
    assert problem.solve(Iterative(tol=1e-9)).stats["start"] == "given"


def test_one_dimension_facade(spark):
    assert w2(SumOfDiracs([0.5]), Image([1.0]), spark) == pytest.approx(1 / 12)
    plan = ot_solve(SumOfDiracs([1.0]), Image([1.0, 1.0]), spark, with_barycenters=True)
    assert plan.cost == pytest.approx(1 / 3) and plan.barycenters == pytest.approx([1.0])


def test_laplacian_dense_and_iterative_agree():
    x = np.random.default_rng(8).uniform(size=(700, 2))
    s, rhs = Sweeper(x, Uniform())(np.zeros(700)), np.random.default_rng(9).normal(size=700)
    a = laplacian_solve(700, s.i, s.k, s.c, rhs)
    m = np.diag(np.bincount(s.i, s.c, 700))
    np.add.at(m, (s.i, s.k), -s.c)
    assert m @ a == pytest.approx(rhs - rhs.mean(), abs=1e-6)


def test_quantization(spark):
    moves = []
    q = quantization(Box([0, 0], [1, 1]), [[0.2, 0.3], [0.7, 0.2], [0.3, 0.8], [0.8, 0.7]], tol=1e-3, callback=lambda k, x, p: moves.append(p.cost))
    assert np.sort(q, 0) == pytest.approx(np.array([[0.25, 0.25]] * 2 + [[0.75, 0.75]] * 2), abs=2e-3)
    assert all(a >= b - 1e-12 for a, b in zip(moves, moves[1:], strict=False))
    p = uniform_in_support(Polygon([[0, 0], [1, 0], [0, 1]]), 500, 0)
    assert (p >= 0).all() and (p.sum(1) <= 1).all()
    d, b = line(spark, [0.1, 0.2, 0.3, 0.9], [1])
    assert sorted(r["x"] for r in lloyd_1d(d, b, 1).collect()) == pytest.approx([0.125, 0.375, 0.625, 0.875])


def test_distributions(spark):
    bare = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, x0 double")
    assert D.dirac_mass(bare).first()["mass"] == 3
    assert D.dirac_mass(bare.withColumn("w", F.array(F.lit(2.0), F.lit(2.0), F.lit(4.0))[F.col("i").cast("int")])).first()["mass"] == 8
    assert {r["w"] for r in D.normalize_diracs(bare).collect()} == {1 / 3}
    assert D.grid_mass(D.grid_table(spark, [[1, 0, 1]]), 2).first()["mass"] == 2
    assert D.grid_mass(D.box_table(spark, [1, 2], [3, 4], 0.5), 2).first()["mass"] == 6
    centre, half = D.largest_cube([[1, 0], [-1, 0], [0, 1], [0, -1]], [2, 0, 1, 0])
    assert half == pytest.approx(0.5) and centre[1] == pytest.approx(0.5)
    assert D.scaled_bessel(2.0, 1e-12)[:2] == pytest.approx([0.308508322, 0.215269289], abs=1e-8)


def test_spreading_keeps_mass(spark):
    from tilewright.operators.densities import triangle_table
    from tilewright.sources import roles

    nodes, corners = roles.grid_mesh(spark, "/root/testdata/sf0.001")
    tri = triangle_table(nodes, corners)
    mass = lambda c: c.join(tri.select("e", "volume"), "e").agg(F.sum(F.col("value") * F.col("volume") / 3)).first()[0]
    for k, method in ((0.5, "iter"), (2.0, "iter"), (3.0, "cheb")):
        assert mass(D.corner_averages(corners, tri, k, method)) == pytest.approx(mass(corners), rel=1e-6)


def test_pieces_are_as_many_as_starts(spark):
    n = 3000
    rng = np.random.default_rng(3)
    x, values, w = rng.uniform(0, n, n), rng.uniform(0, 1, n), rng.pareto(1, n) + 1e-3  # some are far heavier than others
    parts = solve(spark, x, values, w).collect()
    assert n < len(parts) <= 2 * n + 2 * 64
    y, m = np.sort(x), w[np.argsort(x)] / w.sum()
    ends, edges = np.cumsum(m), np.concatenate([[0], np.cumsum(values / values.sum())])
    cuts = np.unique(np.concatenate([ends, edges]))
    cuts = cuts[(cuts >= 0) & (cuts <= 1)]
    middle = (cuts[1:] + cuts[:-1]) / 2
    p, k = y[np.minimum(np.searchsorted(ends, middle), n - 1)], np.minimum(np.searchsorted(edges, middle) - 1, n - 1)
    d = values[k] / values.sum()
    a, b = (k + (c - edges[k]) / d for c in (cuts[:-1], cuts[1:]))
    want = (d * ((b - p) ** 3 - (a - p) ** 3) / 3).sum()
    assert sum(r["y"] * ((r["x1"] - r["p"]) ** 3 - (r["x0"] - r["p"]) ** 3) / 3 for r in parts) == pytest.approx(want, rel=1e-8)
    diracs, bins = line(spark, x, values, w)
    assert T.closed_form_cost(T.source_intervals(diracs), T.target_intervals(bins)).first()["cost"] == pytest.approx(want, rel=1e-6)


def test_membership_with_heavy_and_far_seeds(spark):
    rng = np.random.default_rng(8)
    seeds, w, points = rng.uniform(0, 1, (60, 2)) ** 3, rng.normal(0, 0.02, 60), rng.uniform(-0.2, 1.2, (200, 2))
    w[0] = 0.5
    want = (((points[:, None] - seeds) ** 2).sum(2) - w).argmin(1)
    s = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(seeds, w, strict=True))], "i long, x0 double, x1 double, w double")
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "q long, x0 double, x1 double")
    assert {r["q"]: r["i"] for r in P.membership(q, s, 9).collect()} == dict(enumerate(want.tolist()))
    assert P.membership(q, s.limit(0)).count() == 0


def test_hierarchy_solves_like_a_dense_matrix():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 2))
    s = Sweeper(x, Uniform())(np.zeros(3000))
    rhs = rng.normal(size=3000)
    rhs -= rhs.mean()
    v, steps = multilevel.solve(3000, s.i, s.k, s.c, rhs, x, 1e-9)
    assert steps < 80
    assert np.bincount(s.i, s.c * (v[s.i] - v[s.k]), 3000) == pytest.approx(rhs, abs=1e-6)


def test_residual_families_reach_the_same_plan():
    x = np.random.default_rng(4).uniform(0.01, 0.99, (60, 2)) ** 2
    want = ot_solve(SumOfDiracs(x), Box([0, 0], [1, 1]), tol=1e-9)
    for family in ("lin", "log", 0.5):
        plan = ot_solve(SumOfDiracs(x), Box([0, 0], [1, 1]), tol=1e-9, residual=family)
        assert plan.converged and plan.weights == pytest.approx(want.weights, abs=1e-7)
    for wrong in ({"residual": "cubic"}, {"residual": -1.0}, {"on_failure": "shrug"}, {"continuation": "maybe"}, {"weights0": x[:, 0], "ot_plan": want}):
        with pytest.raises(ValueError):
            Iterative(**wrong)


def test_solid_cells_and_solve():
    rng = np.random.default_rng(2)
    box, ids = box_ring([0, 0, 0], [1, 2, 1])
    x = rng.uniform(0, 1, (200, 3)) * [1, 2, 1]
    w = rng.normal(0, 0.01, 200)
    m, (i, k, c, _) = sweep3.sweep(x, w, np.arange(200), box, ids, Uniform())
    assert m[:, 0].sum() == pytest.approx(2) and m[:, 1:4].sum(0) == pytest.approx([1, 2, 1]) and (m[:, 0] == 0).any()
    assert m[:, 4].sum() == pytest.approx(2 * (1 / 3 + 4 / 3 + 1 / 3))
    full = np.zeros((200, 200))
    np.add.at(full, (i, k), c)
    assert np.abs(full - full.T).max() < 1e-9
    e = 1e-6
    moved = sweep3.sweep(x, w + e * (np.arange(200) == i[0]), np.arange(200), box, ids, Uniform())[0]
    want = -full[:, i[0]]
    want[i[0]] = full[i[0]].sum()
    assert (moved[:, 0] - m[:, 0]) / e == pytest.approx(want, abs=1e-3)
    twice = np.concatenate([x[:20], x[:3]])
    m = sweep3.sweep(twice, np.zeros(23), np.arange(23), box, ids, Uniform())[0]
    assert m[:, 0].sum() == pytest.approx(2) and (m[20:, 0] == 0).all()
    plan = ot_solve(SumOfDiracs(x[:40]), Box([0, 0, 0], [1, 2, 1]), tol=1e-10)
    assert plan.converged and plan.cell_masses == pytest.approx(np.full(40, 1 / 40)) and plan.barycenters.shape == (40, 3)


def test_mesh_target():
    rng = np.random.default_rng(6)
    k = np.arange(36).reshape(6, 6)
    nodes = np.stack(np.meshgrid(np.linspace(0, 1, 6), np.linspace(0, 1, 6), indexing="ij"), -1).reshape(-1, 2)
    triangles = np.concatenate([np.stack([k[:-1, :-1], k[1:, :-1], k[:-1, 1:]], -1).reshape(-1, 3), np.stack([k[1:, 1:], k[1:, :-1], k[:-1, 1:]], -1).reshape(-1, 3)])
    flat = Mesh(nodes, triangles, np.ones(36))
    x = rng.uniform(0.05, 0.95, (30, 2))
    a, b = (ot_solve(SumOfDiracs(x), t, tol=1e-10) for t in (flat, Box([0, 0], [1, 1])))
    assert a.weights == pytest.approx(b.weights, abs=1e-7) and a.cost == pytest.approx(b.cost)
    slope = Mesh(nodes, triangles, nodes[:, 0])  # f = x
    assert slope.mass == pytest.approx(0.5) and slope.spread(3).mass == pytest.approx(0.5)
    whole = Sweeper(x, slope.density(), *slope.domain())(np.zeros(30)).moments.sum(0)
    assert whole == pytest.approx([1, 2 / 3, 0.5, 2 * (1 / 4 + 1 / 6)])
    bump = Mesh(nodes, triangles, (np.arange(36) == 14).astype(float))  # most of the mesh is empty
    plan = ot_solve(SumOfDiracs(x), bump, tol=1e-8)
    assert plan.converged and plan.cell_masses == pytest.approx(np.full(30, 1 / 30), abs=1e-7)
    steps, wide = next(bump.wider())
    assert steps > 1 and wide.values.max() <= 3 * bump.mass
    with pytest.raises(ValueError):
        Mesh(nodes, triangles, np.ones(7))


def test_near_seeds_share_a_cell():
    rng = np.random.default_rng(9)
    x = rng.uniform(0.1, 0.9, (40, 2))
    x[30:] = x[:10] + 1e-12 * rng.normal(size=(10, 2))
    x[39] = x[38]
    plan = ot_solve(SumOfDiracs(x), Box([0, 0], [1, 1]), tol=1e-9)
    assert plan.stats["status"] == "converged (aggregated)" and plan.cell_masses == pytest.approx(np.full(40, 1 / 40))
    assert plan.clusters.tolist()[30:38] == list(range(8)) and (plan.clusters[:30] == np.arange(30)).all()
    alone = ot_solve(SumOfDiracs(x[:30], np.bincount(plan.clusters)), Box([0, 0], [1, 1]), tol=1e-9)
    assert plan.cost == pytest.approx(alone.cost, rel=1e-8) and plan.weights[:30] == pytest.approx(alone.weights, abs=1e-9)
    chain = near_rows(np.array([[0.0, 0], [5, 5], [1, 0], [2, 0.5], [5, 5], [3, 0.5]]), 1.2)
    assert chain.tolist() == [0, 1, 0, 0, 1, 0]


def test_mass_derivatives_by_differences():
    rng = np.random.default_rng(1)
    x, m, e = rng.uniform(0.05, 0.95, (12, 2)), rng.uniform(0.5, 1.5, 12), 1e-5
    m /= m.sum()
    step = rng.normal(size=12) * m
    step -= step.mean()
    low, mid, high = (ot_solve(SumOfDiracs(x, m + s * step), Box([0, 0], [1, 1]), tol=1e-13) for s in (-e, 0, e))
    want = (high.weights - low.weights) / (2 * e)
    got = mass_derivative_of_weights(mid, step)
    assert got - got[0] == pytest.approx(want - want[0], abs=1e-4)
    assert mid.mass_gradient() @ step == pytest.approx((high.cost - low.cost) / (2 * e), abs=1e-6)


def test_blocks_planes_and_spreading_start(spark):
    tiles = D.grid_table(spark, [[1, 1, 0, 1], [1, 1, 0, 1], [0, 1, 1, 0]])
    assert {tuple(r) for r in D.merged_blocks(tiles).select("a0", "b0", "a1", "b1").collect()} == {(0, 1, 0, 1), (0, 1, 3, 3), (2, 2, 1, 2)}
    assert D.merged_blocks(D.grid_table(spark, [[4, 1], [4, 4]]), 0.5).count() == 2
    long = D.polygon_planes(spark, [[0, 0], [2, 0], [0, 2]]).select("k", *[(F.col(c) * 3).alias(c) for c in ("n0", "n1", "off")])
    unit = D.normalized_planes(long, 2).collect()
    assert all(r["n0"] ** 2 + r["n1"] ** 2 == pytest.approx(1) for r in unit) and max(r["off"] for r in unit) == pytest.approx(2**0.5)
    volumes = spark.createDataFrame([(0, 1.0), (1, 1.0)], "e int, volume double")
    corner = lambda a, b: spark.createDataFrame([(e, c, v, x) for e, vs, x in ((0, (0, 1, 2), a), (1, (1, 2, 3), b)) for c, v in enumerate(vs)], "e int, c int, v int, value double")
    assert D.spread_start(corner(1.0, 1.0), volumes) == 1
    assert D.spread_start(corner(1.0, 0.0), volumes, 1.2) > D.spread_start(corner(1.0, 0.0), volumes, 1.9)


def test_presorted_sources(spark):
    d, b = line(spark, [0.1, 0.2, 0.3, 0.9], [1])
    a, c = (np.array(sorted((r["i"], r["w0"], r["w1"]) for r in T.source_intervals(d, presorted=p).collect())) for p in (True, False))
    assert a == pytest.approx(c)


def test_tensor_quotients(spark):
    from tilewright.operators import tensor as A

    t = lambda v: spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "l int, v double")
    a, b = t([7, -7, 5]), t([2, 2, -2])
    for f, want in ((A.div, [3.5, -3.5, -2.5]), (A.floordiv, [3, -4, -3]), (A.mod, [1, 1, -1])):
        assert {r["l"]: r["v"] for r in f(a, b).collect()} == dict(enumerate(want))
