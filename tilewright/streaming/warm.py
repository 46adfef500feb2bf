"""Transport over a stream: each micro-batch's points are solved from the last plan's weights.

The stream is aggregated first, so what reaches the driver is one row per seed, a number fixed by its grid.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problem import Iterative, OtProblem, PlanNd, SumOfDiracs


def binned(points: DataFrame, cells: int) -> DataFrame:
    """(i, x0, x1, w): points (x0, x1) of the unit square, counted on a grid; each tile is a dirac at its points' mean."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * cells), F.lit(0)), F.lit(cells - 1))
    key = (at("x0") * cells + at("x1")).cast("long")
    return points.groupBy(key.alias("i")).agg(F.avg("x0").alias("x0"), F.avg("x1").alias("x1"), F.count("*").cast("double").alias("w"))


class StreamingTransport:
    """foreachBatch sink: sums of all points so far by tile, and the plan of their distribution to the target.

    After each batch the sums and weights are written under its number, in the folder state. A batch starts from what
    the last one before it left there, so one that is run again counts once and a restart goes on where it stopped.
    """

    def __init__(self, target, cells: int = 16, settings: Iterative | None = None, on_plan: Callable[[int, PlanNd], None] | None = None, state: str | None = None):
        self.target, self.cells, self.settings, self.on_plan, self.state = target, cells, settings or Iterative(tol=1e-6), on_plan, state
        self.sums, self.weights, self.plan = np.zeros((cells * cells, 3)), np.zeros(cells * cells), None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.state:
            self._load(batch.sparkSession, batch_id)
        rows = binned(batch, self.cells).toPandas()
        for i, x0, x1, w in rows[["i", "x0", "x1", "w"]].itertuples(index=False):
            self.sums[int(i)] += [x0 * w, x1 * w, w]
        live = np.flatnonzero(self.sums[:, 2] > 0)
        if len(rows):
            x = self.sums[live, :2] / self.sums[live, 2:]
            problem = OtProblem(SumOfDiracs(x, self.sums[live, 2]), self.target)
            start = Iterative(**{**self.settings.__dict__, "weights0": self.weights[live]})
            self.plan = problem.solve(start)
            self.weights[live] = self.plan.weights
        if self.state:
            self._save(batch.sparkSession, batch_id)
        if len(rows) and self.on_plan is not None:
            self.on_plan(batch_id, self.plan)

    def _saved(self, spark: SparkSession) -> list[int]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        whole = [n for n in names if n.startswith("batch=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{n}/_SUCCESS"))]
        return sorted(int(n[6:]) for n in whole)

    def _load(self, spark: SparkSession, batch_id: int) -> None:
        self.sums[:], self.weights[:] = 0, 0
        earlier = [b for b in self._saved(spark) if b < batch_id]
        if earlier:
            for r in spark.read.parquet(f"{self.state}/batch={earlier[-1]}").collect():  # one row a tile
                self.sums[r["i"]], self.weights[r["i"]] = (r["s0"], r["s1"], r["w"]), r["weight"]

    def _save(self, spark: SparkSession, batch_id: int) -> None:
        rows = [(int(i), *map(float, self.sums[i]), float(self.weights[i])) for i in np.flatnonzero(self.sums[:, 2] > 0)]
        spark.createDataFrame(rows, "i int, s0 double, s1 double, w double, weight double").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        self.state = self.state or f"{checkpoint.rstrip('/')}-sums"
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_mass(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, mass, mean): dirac masses and first moments of (ts, event_type, value) by event time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").cast("double").alias("mass"), F.avg("value").alias("mean"))
