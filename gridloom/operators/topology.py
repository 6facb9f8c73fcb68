"""Triangles from a nearest-seed raster: block scan, quad cut, dedup and ranks, adjacency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import squared_distance
from gridloom.operators.ranking import with_rank
from gridloom.operators.voronoi import spread

#: Seeds whose triangles are numbered by one task.
RANK_BUCKET = 4096
#: Side of the tiles whose blocks are scanned together.
SCAN_TILE = 256


def raw_bound(width: int, height: int) -> int:
    """Most witnesses a raster of this size can give: two for each 2 x 2 block."""
    return 2 * (width - 1) * (height - 1)


def blocks(raster: DataFrame) -> DataFrame:
    """(px, py, ids) for 2 x 2 blocks with three or four different seeds; ids in the order tl, tr, bl, br.

    Pixels are grouped by tile, with the first column and row of the next tiles, and a tile is scanned as a whole; a
    block with a missing pixel is none.
    """
    kind = raster.schema["seed_id"].dataType.simpleString()

    def scan(rows: pa.Table) -> pa.Table:
        px, py, ids = (rows.column(n).to_numpy() for n in ("px", "py", "seed_id"))
        x0, y0 = px.min(), py.min()
        seen = np.full((py.max() - y0 + 1, px.max() - x0 + 1), -1, np.int64)
        seen[py - y0, px - x0] = ids
        four = np.stack([seen[:-1, :-1], seen[:-1, 1:], seen[1:, :-1], seen[1:, 1:]], axis=-1)
        new = np.ones(four.shape, bool)  # not met before in its block
        for i in range(1, 4):
            new[..., i] = (four[..., i : i + 1] != four[..., :i]).all(axis=-1)
        at = np.nonzero((new.sum(axis=-1) >= 3) & (four >= 0).all(axis=-1))
        four, new = four[at], new[at]
        ends = np.concatenate([[0], np.cumsum(new.sum(axis=-1))]).astype(np.int32)
        return pa.table({"px": (at[1] + x0).astype(np.int32), "py": (at[0] + y0).astype(np.int32), "ids": pa.ListArray.from_arrays(ends, four[new])})

    tile = lambda v: F.floor(F.col(v) / SCAN_TILE)
    name = lambda x, y: y * (1 << 32) + x
    x, y = tile("px"), tile("py")
    edge = (F.pmod("px", F.lit(SCAN_TILE)) == 0) | (F.pmod("py", F.lit(SCAN_TILE)) == 0)
    before = lambda v: F.floor((F.col(v) - 1) / SCAN_TILE)
    every = F.array_distinct(F.array(name(x, y), name(before("px"), y), name(x, before("py")), name(before("px"), before("py"))))
    dealt = raster.select(F.explode(F.when(edge, every).otherwise(F.array(name(x, y)))).alias("tile"), "px", "py", F.col("seed_id").cast("long").alias("seed_id"))
    found = spread(dealt, "tile").groupBy("tile").applyInArrow(scan, "px int, py int, ids array<bigint>")
    return found.select("px", "py", F.col("ids").cast(f"array<{kind}>").alias("ids"))


def cut_quads(quads: DataFrame, seeds: DataFrame) -> DataFrame:
    """(px, py, ids, p, q): the diagonal p < q at which each block of four seeds is cut.

    The seeds are ordered by angle around their centroid, in whole numbers scaled by four; the shorter
    diagonal wins, and of two equal ones the one without the lowest id.
    """
    at = quads.select("px", "py", "ids", F.posexplode("ids").alias("pos", "seed_id")).join(seeds.select("seed_id", "x", "y"), "seed_id")
    mates = F.collect_list(F.struct("pos", "seed_id", "x", "y")).alias("four")
    four = at.groupBy("px", "py", "ids").agg(mates, F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    ring = F.array_sort(F.transform("four", lambda s: F.struct(F.atan2((4 * s["y"] - F.col("sy")).cast("double"), (4 * s["x"] - F.col("sx")).cast("double")).alias("angle"), s["pos"].alias("pos"), s["seed_id"].alias("id"), s["x"].alias("x"), s["y"].alias("y"))))
    ringed = four.select("px", "py", "ids", ring.alias("ring"))
    s = [F.col("ring")[i] for i in range(4)]
    ringed = ringed.withColumns(
        {
            "d0": squared_distance(s[0]["x"], s[0]["y"], s[2]["x"], s[2]["y"]),
            "d1": squared_distance(s[1]["x"], s[1]["y"], s[3]["x"], s[3]["y"]),
            "low": F.array_min("ids"),
        }
    )
    first = (F.col("d0") < F.col("d1")) | ((F.col("d0") == F.col("d1")) & (F.col("low") != s[0]["id"]) & (F.col("low") != s[2]["id"]))
    a, b = F.when(first, s[0]["id"]).otherwise(s[1]["id"]), F.when(first, s[2]["id"]).otherwise(s[3]["id"])
    return ringed.select("px", "py", "ids", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))


def witnesses(raster: DataFrame, seeds: DataFrame) -> DataFrame:
    """(x, y, a, b, c) with a < b < c: one row for each triangle a block shows, at the block's top left."""
    found = blocks(raster)
    triples = found.where(F.size("ids") == 3).select("px", "py", F.array_sort("ids").alias("t"))
    cut = cut_quads(found.where(F.size("ids") == 4), seeds)
    others = F.array_except("ids", F.array("p", "q"))
    halves = cut.select("px", "py", F.explode(F.transform(others, lambda o: F.array_sort(F.array("p", "q", o)))).alias("t"))
    every = triples.unionByName(halves)
    return every.select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def with_corners(triangles: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds ax .. cy, the coordinates of the three seeds."""
    for name in "abc":
        own = seeds.select(F.col("seed_id").alias(name), F.col("x").alias(name + "x"), F.col("y").alias(name + "y"))
        triangles = triangles.join(own, name)
    return triangles


def first_witness(found: DataFrame) -> DataFrame:
    """(x, y, a, b, c): of each triple the witness with least (y, x), both in one BIGINT so that rows are hashed, not sorted."""
    packed = F.col("y").cast("long") * (1 << 32) + F.col("x") + (1 << 31)
    one = found.groupBy("a", "b", "c").agg(F.min(packed).alias("at"))
    y = F.shiftright("at", 32)
    return one.select((F.col("at") - F.shiftleft(y, 32) - (1 << 31)).cast("int").alias("x"), y.cast("int").alias("y"), "a", "b", "c")


def triangles(found: DataFrame) -> DataFrame:
    """(triangle_id, x, y, a, b, c): distinct triples of ``witnesses``, ranked; (x, y) is the one with least (y, x).

    The witnesses are read twice, to count and to number, so they should be persisted.
    """
    one = first_witness(found)
    ranked = with_rank(one, (F.col("a") / RANK_BUCKET).cast("int"), ("a", "b", "c"), "triangle_id")
    return ranked.select("triangle_id", "x", "y", "a", "b", "c")


def adjacency(triangles: DataFrame) -> DataFrame:
    """(seed_id, triangle_id): the triangles at each seed."""
    return triangles.select(F.explode(F.array("a", "b", "c")).alias("seed_id"), "triangle_id")
