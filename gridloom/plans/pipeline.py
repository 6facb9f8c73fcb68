"""The batch entry points: one diagram, its triangles, and the pixels' triangles."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.padding import resolve_padding
from gridloom.operators import assign as _assign
from gridloom.operators import topology, voronoi
from gridloom.operators.seeds import check_size, rank_seeds, validate_seeds
from gridloom.sources.seeds import seeds_from, to_array, to_map, to_raster


@dataclass
class Triangulation:
    """Lazy results: ranked seeds, padded diagram, diagram, triangles and the pixels with their triangle."""

    width: int
    height: int
    border_padding: int
    seeds: DataFrame
    padded: DataFrame
    diagram: DataFrame
    triangles: DataFrame
    grid: DataFrame
    timings: dict[str, float] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def triangle_map(self) -> dict[int, tuple[int, int, int, int, int]]:
        return to_map(self.triangles)

    def triangle_array(self) -> np.ndarray:
        return to_array(self.triangles)

    def raster(self) -> np.ndarray:
        """(height, width, 3): seed_id, dist2, triangle_id."""
        return to_raster(self.grid, self.width, self.height, "seed_id", "dist2", "triangle_id")

    def fetch(self, as_arrays: bool) -> tuple[dict | np.ndarray, np.ndarray]:
        """Triangles and raster on the driver; what is persisted is released."""
        out = (self.triangle_array() if as_arrays else self.triangle_map()), self.raster()
        for df in self.held:
            df.unpersist()
        return out


def plan(seeds: DataFrame, width: int, height: int, border_padding: int | None = None, strategy: str = "auto") -> Triangulation:
    """Results over ranked seeds (seed_id, x, y); nothing is validated. The diagram is computed once, if persisted."""
    padding = resolve_padding(border_padding)
    padded = voronoi.voronoi(seeds, width, height, padding, strategy)
    diagram = voronoi.crop(padded, width, height) if padding else padded
    found = topology.triangles(topology.witnesses(padded, seeds))
    return Triangulation(width, height, padding, seeds, padded, diagram, found, _assign.assign(diagram, found, seeds))


def triangulate_frame(spark: SparkSession, width: int, height: int, seeds, border_padding: int | None = None, strategy: str = "auto", timed: bool = False) -> Triangulation:
    """Validate and rank the seeds, then plan; seeds, diagram, witnesses and triangles are persisted, as each is used twice."""
    check_size(width, height)
    resolve_padding(border_padding)
    given = seeds_from(spark, seeds)
    validate_seeds(given, width, height)
    ranked = rank_seeds(given).persist()
    out = plan(ranked, width, height, border_padding, strategy)
    padded = out.padded.persist()
    began = time.perf_counter()
    if timed:
        padded.count()
        out.timings["voronoi_ms"] = (time.perf_counter() - began) * 1e3
        began = time.perf_counter()
    found = topology.witnesses(padded, ranked).persist()
    if timed:
        found.count()
        out.timings["detect_ms"] = (time.perf_counter() - began) * 1e3
    out.padded = padded
    out.diagram = voronoi.crop(padded, width, height) if out.border_padding else padded
    began = time.perf_counter()
    out.triangles = topology.triangles(found).persist()
    out.held = [ranked, padded, found, out.triangles]
    if timed:
        out.triangles.count()
        out.timings["dedup_ms"] = (time.perf_counter() - began) * 1e3
        began = time.perf_counter()
    out.grid = _assign.assign(out.diagram, out.triangles, ranked)
    if timed:
        out.grid.write.format("noop").mode("overwrite").save()
        out.timings["assign_ms"] = (time.perf_counter() - began) * 1e3
    return out


def triangulate(width: int, height: int, seeds, border_padding: int | None = -1, as_arrays: bool = False, spark: SparkSession | None = None):
    """(triangles, grid) on the driver: a dict or an (N, 3) array, and a (height, width, 3) array."""
    spark = spark or SparkSession.getActiveSession()
    t = triangulate_frame(spark, width, height, seeds, border_padding)
    return t.fetch(as_arrays)


class Voronoi:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()

    def compute(self, width: int, height: int, seeds) -> np.ndarray:
        """(height, width, 2): seed_id, squared distance."""
        given = seeds_from(self.spark, seeds)
        validate_seeds(given, width, height)
        return to_raster(voronoi.voronoi(rank_seeds(given), width, height), width, height, "seed_id", "dist2")


class GridTriangulation:
    """Two-step form: takes the diagram's shape for the image size and builds one diagram of its own."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()

    def _run(self, grid: np.ndarray, seeds, border_padding: int | None, timed: bool = False) -> Triangulation:
        if grid.ndim != 3 or grid.shape[2] != 2:
            raise ValueError("the diagram must have shape (height, width, 2)")
        return triangulate_frame(self.spark, grid.shape[1], grid.shape[0], seeds, border_padding, timed=timed)

    def compute(self, grid: np.ndarray, seeds, border_padding: int | None = -1, as_arrays: bool = False):
        t = self._run(grid, seeds, border_padding)
        return t.fetch(as_arrays)

    def compute_timed(self, grid: np.ndarray, seeds, border_padding: int | None = -1, as_arrays: bool = False):
        t = self._run(grid, seeds, border_padding, timed=True)
        return *t.fetch(as_arrays), t.timings

    def compute_debug(self, grid: np.ndarray, seeds, border_padding: int | None = -1, as_arrays: bool = False):
        """Also the padded diagram, (height + 2 P, width + 2 P, 2)."""
        from pyspark.sql import functions as F

        t = self._run(grid, seeds, border_padding)
        p = t.border_padding
        moved = t.padded.withColumns({"px": F.col("px") + p, "py": F.col("py") + p})
        raster = to_raster(moved, t.width + 2 * p, t.height + 2 * p, "seed_id", "dist2")
        return *t.fetch(as_arrays), raster
