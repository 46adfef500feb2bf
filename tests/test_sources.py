import xml.etree.ElementTree as ET

import numpy as np
import pytest

from tilewright.operators import diagram as P
from tilewright.plans.problem import Box
from tilewright.sources import clouds, display
from tilewright.streaming.warm import StreamingTransport, windowed_mass


def test_cloud_files(spark, tmp_path):
    cloud = clouds.uniform_cloud(spark, 20, 2, 1, 0.1)
    clouds.write_cloud(cloud, str(tmp_path / "cloud"))
    again = clouds.read_cloud(spark, str(tmp_path / "cloud"))
    rows = lambda df: np.array(sorted(map(tuple, df.collect())))
    assert rows(again) == pytest.approx(rows(cloud))
    (tmp_path / "bad.txt").write_text("# two\n3\n0 0 1\n1 1 1\n")
    with pytest.raises(ValueError):
        clouds.read_cloud(spark, str(tmp_path / "bad.txt"))


def test_generators(spark):
    for cloud, d in ((clouds.lines_cloud(spark, 50), 2), (clouds.planes_cloud(spark, 50), 3)):
        x = np.array([[r[f"x{a}"] for a in range(d)] for r in cloud.collect()])
        assert x.shape == (50, d) and (x > 0).all() and (x < 1).all()
    w = [r["w"] for r in clouds.uniform_cloud(spark, 400, 2, 1, 0.5).collect()]
    assert max(map(abs, w)) <= 0.5 / 400 < 2.2 * max(map(abs, w))
    x = np.array([[r["x0"], r["x1"]] for r in clouds.lines_cloud(spark, 2000, 3, 1, 0.0).collect()])
    spread = np.linalg.svd(x - x.mean(0))[1]
    assert spread[1] < 0.05 * spread[0] and np.ptp(x, 0).max() > 0.45  # one chord, across the square
    x = np.array([[r["x0"], r["x1"], r["x2"]] for r in clouds.planes_cloud(spark, 2000, 3, 1, 0.0).collect()])
    assert np.linalg.svd(x - x.mean(0))[1][2] < 0.01 * len(x) ** 0.5
    pixels = {(r["k0"], r["k1"]): r["value"] for r in clouds.synthetic_image(spark, 50, True).collect()}
    assert len(pixels) == 2500 and pixels[35, 10] == 0 and pixels[15, 35] > 3 and pixels[20, 20] > 5
    assert clouds.four_gaussians(spark).agg({"mass": "sum"}).first()[0] == pytest.approx(1)


def test_display(spark, tmp_path):
    seeds = spark.createDataFrame([(0, 0.25, 0.5, 0.0), (1, 0.75, 0.5, 0.0)], "i long, x0 double, x1 double, w double")
    cells = display.rings(P.vertices(P.facets2(P.cell_planes(seeds, P.unit_box(spark, 2), 2), ["i"]), ["i"]))
    assert {k: len(v) for k, v in cells.items()} == {0: 4, 1: 4}
    scene = display.Scene().add_faces(cells).frame().add_points([[0, 0]]).add_edges([[[0, 0], [1, 1]]])
    scene.save(str(tmp_path / "cells.html"))
    assert "canvas" in (tmp_path / "cells.html").read_text() and "iframe" in scene._repr_html_()
    display.write_vtu(str(tmp_path / "cells.vtu"), cells, {"mass": {0: 0.5, 1: 0.5}})
    piece = ET.parse(tmp_path / "cells.vtu").find("UnstructuredGrid/Piece")
    assert piece.get("NumberOfCells") == "2"
    display.write_pvd(str(tmp_path / "all.pvd"), [(0.0, "cells.vtu")])
    display.write_convergence_html({"residual": [1, 0.1, 1e-6, 0]}, str(tmp_path / "curve.html"))
    assert "polyline" in (tmp_path / "curve.html").read_text()


def test_streaming(spark, tmp_path):
    seen = []
    rows = clouds.uniform_cloud(spark, 200, 2, 3)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = StreamingTransport(Box([0, 0], [1, 1]), 4, on_plan=lambda k, p: seen.append(p.stats["start"]))
    sink.start(stream, str(tmp_path / "state")).awaitTermination()
    assert len(seen) == 2 and sink.sums[:, 2].sum() == 200
    assert np.abs(sink.plan.cell_masses - sink.plan.target_masses).max() < 1e-5
    before, again = sink.sums.copy(), StreamingTransport(Box([0, 0], [1, 1]), 4, state=sink.state)
    last = spark.read.parquet(*sorted(str(f) for f in (tmp_path / "in").glob("*.parquet"))[1:])
    again(last, 1)  # after a restart the last batch is run again
    assert again.sums[:, 2].sum() == 200 or np.allclose(again.sums, before)
    again(last.limit(0), 2)
    assert again.sums[:, 2].sum() == sink.sums[:, 2].sum() == 200
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    assert windowed_mass(events).isStreaming
