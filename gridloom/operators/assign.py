"""Containment: the highest triangle that holds a pixel or point, by a tile-binned join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import cross, in_triangle, inside_circumsphere
from gridloom.operators.topology import with_corners
from gridloom.operators.voronoi import spread

NO_TRIANGLE = -1
TILE = 16
#: Rows of triangles, and pixels, that are laid out at a time; one triangle's rows and one row's pixels are never split.
FILL = 1 << 20
CORNERS = ("ax", "ay", "bx", "by", "cx", "cy")


def tiled(triangles: DataFrame, tile: int = TILE) -> DataFrame:
    """Triangles with corners, repeated for each tile (tx, ty) that their bounding box touches; flat ones are left out."""
    c = {n: F.col(n) for n in ("ax", "ay", "bx", "by", "cx", "cy")}
    area = cross(c["ax"], c["ay"], c["bx"], c["by"], c["cx"], c["cy"])
    bin_ = lambda v: F.floor(v / tile).cast("int")
    span = lambda k: F.sequence(bin_(F.least(f"a{k}", f"b{k}", f"c{k}")), bin_(F.greatest(f"a{k}", f"b{k}", f"c{k}")))
    return triangles.where(area != 0).withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))


def containing(points: DataFrame, triangles: DataFrame, seeds: DataFrame, keys: tuple[str, ...], x: str = "px", y: str = "py", tile: int = TILE) -> DataFrame:
    """(keys, triangle_id) for the points that some triangle holds."""
    corners = tiled(with_corners(triangles, seeds), tile)
    bins = points.withColumns({"tx": F.floor(F.col(x) / tile).cast("int"), "ty": F.floor(F.col(y) / tile).cast("int")})
    held = bins.join(corners.drop("x", "y", "a", "b", "c"), ["tx", "ty"]).where(in_triangle(F.col(x), F.col(y)))
    return held.groupBy(*keys).agg(F.max("triangle_id").alias("triangle_id"))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (triangle_id, ax, ay, bx, by, cx, cy) to their pixels, exact in whole numbers.

    Each edge bounds the pixels of a row from one side, so a row of a triangle is a range of pixels.
    """
    for batch in batches:
        tid, ax, ay, bx, by, cx, cy = (c.to_numpy().astype(np.int64) for c in batch.columns)
        turned = (bx - ax) * (cy - ay) < (by - ay) * (cx - ax)
        bx, cx = np.where(turned, cx, bx), np.where(turned, bx, cx)
        by, cy = np.where(turned, cy, by), np.where(turned, by, cy)
        top = np.minimum(np.minimum(ay, by), cy)
        n = np.maximum(np.maximum(ay, by), cy) - top + 1
        for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // FILL)) + 1):
            of = np.repeat(some, n[some])
            y = top[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            low, high = np.full(len(of), -(1 << 40)), np.full(len(of), 1 << 40)
            for ix, iy, jx, jy in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)):
                # on the inner side of the edge from i to j: rise * px <= run * (py - iy) + rise * ix
                rise = (jy - iy)[of]
                bound = (jx - ix)[of] * (y - iy[of]) + rise * ix[of]
                steep = np.abs(rise) + (rise == 0)
                high = np.where(rise > 0, np.minimum(high, bound // steep), high)
                low = np.where(rise < 0, np.maximum(low, -(bound // steep)), low)
            wide = np.maximum(high - low + 1, 0)
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(wide) // FILL)) + 1):
                at = np.repeat(part, wide[part])
                x = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(wide[part]) - wide[part], wide[part])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y[at], pa.int32()), pa.array(tid[of[at]], pa.int32())], ["px", "py", "triangle_id"])


def covered(triangles: DataFrame) -> DataFrame:
    """(px, py, triangle_id) for every pixel of every triangle with corners, borders included; flat ones have none.

    The work grows with the triangles' areas and heights, and nothing is joined.
    """
    corners = triangles.where(cross(*(F.col(n) for n in CORNERS)) != 0).select("triangle_id", *CORNERS)
    return spread(corners, "triangle_id").mapInArrow(_fill, "px int, py int, triangle_id int")


def assign(raster: DataFrame, triangles: DataFrame, seeds: DataFrame) -> DataFrame:
    """(px, py, seed_id, dist2, triangle_id): -1 where no triangle holds the pixel. Pixels and triangles meet in one aggregation."""
    held = covered(with_corners(triangles, seeds))
    both = raster.select("px", "py", "seed_id", "dist2").unionByName(held, allowMissingColumns=True)
    one = both.groupBy("px", "py").agg(*(F.max(n).alias(n) for n in ("seed_id", "dist2", "triangle_id"))).where("seed_id IS NOT NULL")
    return one.withColumn("triangle_id", F.coalesce("triangle_id", F.lit(NO_TRIANGLE)))


def locate(points: DataFrame, triangles: DataFrame, seeds: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds triangle_id to points (qid, x, y, ...); points outside everything get -1."""
    held = containing(points.select("qid", "x", "y"), triangles, seeds, ("qid",), "x", "y", tile)
    return points.join(held, "qid", "left").withColumn("triangle_id", F.coalesce("triangle_id", F.lit(NO_TRIANGLE)))


def in_circumsphere(points: DataFrame, triangles: DataFrame, seeds: DataFrame, tile: int = TILE) -> DataFrame:
    """(qid, inside, triangle_id) for points (qid, x, y, t): inside the lifted circumsphere of the triangle that holds them."""
    corners = with_corners(triangles, seeds).select("triangle_id", "ax", "ay", "bx", "by", "cx", "cy")
    at = locate(points, triangles, seeds, tile).join(corners, "triangle_id", "left")
    inside = F.coalesce(inside_circumsphere(F.col("x"), F.col("y"), F.col("t").cast("double")), F.lit(False))
    return at.select("qid", inside.alias("inside"), "triangle_id")


def device_pixels(grid: DataFrame) -> DataFrame:
    """(px, py, pixel_tid, seed_id, outside): -1 becomes 0 and is told by the mask."""
    none = F.col("triangle_id") == NO_TRIANGLE
    return grid.select("px", "py", F.when(none, 0).otherwise(F.col("triangle_id")).alias("pixel_tid"), "seed_id", none.alias("outside"))
