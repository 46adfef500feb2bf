import numpy as np
import pytest

from tilewright.api import PowerDiagram, Voronoi
from tilewright.operators import cells as C
from tilewright.operators.distributions import grid_table
from tilewright.operators.diagram import UNBOUNDED


def test_cells(spark):
    square = C.hypercube(spark, 2)
    assert C.measure(square).first()["area"] == pytest.approx(1)
    assert C.measure(C.hypercube(spark, 2, [1, 1], [[2, 0], [1, 1]])).first()["area"] == pytest.approx(2)
    half = C.cut(square, [1, 1], 1, 7)
    assert C.measure(half).first()["area"] == pytest.approx(0.5)
    assert C.measure(C.cut(square, [1, 0], -1, 7)).count() == 0
    assert C.corners(half).count() == 3 and C.is_bounded(half).first()["is_bounded"] == 1
    open_ = C.hypercube(spark, 2).where("k <> -2")
    assert C.measure(open_).first()["area"] == UNBOUNDED
    assert C.unbounded(spark, 3).count() == 0
    assert C.interval(C.hypercube(spark, 1, [2], [[3]])).first()["length"] == pytest.approx(3)
    box = C.tightest_box(square.unionByName(C.cut(square, [1, 0], 0.4, 9)).distinct(), 2).first()
    assert (box["lo0"], box["hi0"], box["hi1"]) == pytest.approx((0, 0.4, 1))


def test_vertex_enumeration(spark):
    cube = C.hypercube(spark, 3)
    assert C.vertices_of(cube, 3).count() == 8 and C.edges_of(cube).count() == 12
    assert {r["n"] for r in C.faces_of(cube).collect()} == {4}
    corner = C.cut(cube, [1, 1, 1], 0.5, 5)
    assert C.vertices_of(corner, 3).count() == 4 and C.edges_of(corner).count() == 6
    assert C.vertices_of(C.hypercube(spark, 2), 2).count() == 4


def test_blocks_of_cells(spark):
    boxes = spark.createDataFrame([(0, 0.1, 0.2, 0.1, 0.2), (1, 0.4, 0.6, 0.1, 0.2)], "id int, lo0 double, hi0 double, lo1 double, hi1 double")
    blocks = spark.createDataFrame([(0, 0.0, 0.5, 0.0, 1.0), (1, 0.5, 1.0, 0.0, 1.0)], boxes.schema)
    assert {tuple(r) for r in C.blocks_of_cells(boxes, blocks).collect()} == {(0, 0, True), (1, 0, False), (1, 1, False)}


def test_diagram(spark):
    x = np.random.default_rng(0).uniform(size=(12, 2))
    seeds = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i long, x0 double, x1 double")
    with pytest.raises(ValueError):
        Voronoi(PowerDiagram(seeds).seeds)
    v = Voronoi(seeds, buckets=3)
    area = {r["i"]: r["area"] for r in v.measures.collect()}
    assert sum(area.values()) == pytest.approx(1)
    assert {r["i"]: r["moment"] for r in v.moment("1").collect()} == pytest.approx(area)
    tiles = grid_table(spark, np.ones((2, 2)), knots=[[0, 0.5, 1]] * 2)
    assert {r["i"]: r["mass"] for r in v.density_moments(tiles).collect()} == pytest.approx(area)
    assert sum(r["mass"] for r in v.support_pieces(tiles).collect()) == pytest.approx(1)
    assert v.cell(3).count() >= 3
    rhs = spark.createDataFrame([(i, float(i)) for i in range(12)], "i long, v double")
    sol = {r["i"]: r["x"] for r in v.laplacian_solve(rhs).collect()}
    edges = v.hessian_rows().collect()
    assert [sum(e["c"] * (sol[i] - sol[e["k"]]) for e in edges if e["i"] == i) for i in range(12)] == pytest.approx([i - 5.5 for i in range(12)], abs=1e-8)
    heavier = spark.createDataFrame([(i, 10.0 if i == 4 else 0.0) for i in range(12)], "i long, w double")
    assert {r["i"]: r["area"] for r in v.with_weights(heavier).measures.collect()}[4] == pytest.approx(1)


def test_polytope_is_its_polygon():
    from tilewright.api import Polygon, Polytope

    cut = Polytope([[-1, 0], [0, -1], [1, 1], [1, 0]], [0, 0, 1, 5])  # the last one says nothing more
    assert cut.mass == pytest.approx(0.5) and cut.mass == pytest.approx(Polygon([[0, 0], [1, 0], [0, 1]]).mass)
    for open_ in ([[-1, 0], [0, -1], [-1, -1]], [[1, 0], [-1, 0]]):
        with pytest.raises(ValueError):
            Polytope(open_, [1] * len(open_))


def test_transport_outputs():
    from tilewright.api import Box, SumOfDiracs, ot_solve

    plan = ot_solve(SumOfDiracs([[0.25, 0.5], [0.75, 0.5]]), Box([0, 0], [1, 1]))
    cost, centres, masses = plan.transport()
    assert cost == pytest.approx(1 / 48 + 1 / 12) and masses == pytest.approx([0.5, 0.5]) and centres == pytest.approx(np.array([[0.25, 0.5], [0.75, 0.5]]))
    assert plan.cost_and_position_grad()[1] == pytest.approx(np.zeros((2, 2)), abs=1e-9)


def test_default_diagram_is_pruned_and_the_same(spark):
    x = np.random.default_rng(1).uniform(size=(150, 2))
    w = np.random.default_rng(2).normal(0, 0.01, 150)
    seeds = spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, w, strict=True))], "i long, x0 double, x1 double, w double")
    a, b = ({r["i"]: r["area"] for r in PowerDiagram(seeds, buckets=k).measures.collect()} for k in (None, 0))
    assert a == pytest.approx(b, abs=1e-12)
