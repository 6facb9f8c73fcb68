"""Exact nearest-seed rasters. Ties go to the higher seed_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import squared_distance

#: More seeds than this are never broadcast.
MAX_BROADCAST_SEEDS = 20_000
#: Columns of a strip and rows of a band in the transform, and the pixels that neither exceeds.
GROUP_SIDE, GROUP_CELLS = 64, 1 << 20


def canvas(spark: SparkSession, width: int, height: int, padding: int = 0) -> DataFrame:
    """(px, py) for every pixel of the image and its border, in image coordinates."""
    w, h = width + 2 * padding, height + 2 * padding
    i = F.col("id")
    return spark.range(w * h).select((i % w - padding).cast("int").alias("px"), (F.expr(f"id div {w}") - padding).cast("int").alias("py"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Partitioned by ``key`` in the session's number of partitions, which are not merged: groups are small but costly."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _by_comparison(seeds: DataFrame, pixels: DataFrame, ids: int) -> DataFrame:
    """Distance and id share one BIGINT, so the minimum combines in a hash aggregation and nothing is sorted."""
    d = squared_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    packed = d * ids + (ids - 1 - F.col("seed_id").cast("long"))
    best = pixels.join(F.broadcast(seeds.select("seed_id", "x", "y"))).groupBy("px", "py").agg(F.min(packed).alias("best"))
    kind = seeds.schema["seed_id"].dataType
    return best.select("px", "py", (ids - 1 - F.col("best") % ids).cast(kind).alias("seed_id"), F.expr(f"best div {ids}").alias("dist2"))


def _by_transform(seeds: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Two exact passes: the nearest seed of each pixel's column, then the best of the columns within reach.

    The first pass takes strips of columns and starts from their seeds, so columns without one send nothing; the second
    holds a band of rows. What goes from one to the other is a packed piece for each strip and band, so nothing is
    shuffled by pixel. The work grows with the pixels times the distance to their seed, not with the number of seeds.
    """
    far = 1 << 62
    wide, tall = (max(1, min(GROUP_SIDE, GROUP_CELLS // n)) for n in (height, width))

    def strip(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("x", "ascending"), ("y", "ascending")])
        ys, ids = rows.column("y").to_numpy().astype(np.int64), rows.column("seed_id").to_numpy()
        columns, starts = np.unique(rows.column("x").to_numpy(), return_index=True)
        y = np.arange(top, top + height)
        best, who = np.full((height, len(columns)), far), np.full((height, len(columns)), -1)
        for j, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ys)], strict=True)):
            after = np.searchsorted(ys[lo:hi], y, side="right") + lo
            for at in (after - 1, after):
                there = (at >= lo) & (at < hi)
                d = np.where(there, (ys[at.clip(lo, hi - 1)] - y) ** 2, far)
                own = ids[at.clip(lo, hi - 1)]
                gain = there & ((d < best[:, j]) | ((d == best[:, j]) & (own > who[:, j])))
                best[gain, j], who[gain, j] = d[gain], own[gain]
        px = columns.astype("<i4").tobytes()
        cuts = range(0, height, tall)
        d, own = ([x[c : c + tall].tobytes() for c in cuts] for x in (best, who))
        return pa.table({"band": pa.array(range(len(cuts)), pa.int32()), "px": pa.array([px] * len(cuts), pa.binary()), "d": pa.array(d, pa.binary()), "own": pa.array(own, pa.binary())})

    def band(rows: pa.Table) -> pa.Table:
        first = rows.column("band")[0].as_py() * tall
        n = min(tall, height - first)
        d, ids = np.full((n, width), far), np.full((n, width), -1)
        for piece in rows.to_pylist():
            at = np.frombuffer(piece["px"], "<i4") - left
            d[:, at], ids[:, at] = (np.frombuffer(piece[k], np.int64).reshape(n, -1) for k in ("d", "own"))
        best, who, k = d.copy(), ids.copy(), 1
        while k < width and k * k <= best.max():  # columns further and further away, while any pixel can gain
            for here, there in ((np.s_[:, k:], np.s_[:, :-k]), (np.s_[:, :-k], np.s_[:, k:])):
                reach = d[there] + k * k
                gain = (reach < best[here]) | ((reach == best[here]) & (ids[there] > who[here]))
                best[here][gain], who[here][gain] = reach[gain], ids[there][gain]
            k += 1
        px = np.tile(np.arange(left, left + width, dtype=np.int32), n)
        py = np.repeat(np.arange(top + first, top + first + n, dtype=np.int32), width)
        return pa.table({"px": px, "py": py, "seed_id": who.ravel(), "dist2": best.ravel()})

    kind = seeds.schema["seed_id"].dataType
    own = seeds.select(F.floor((F.col("x") - left) / wide).alias("strip"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("seed_id").cast("long").alias("seed_id"))
    near = spread(own, "strip").groupBy("strip").applyInArrow(strip, "band int, px binary, d binary, own binary")
    out = spread(near, "band").groupBy("band").applyInArrow(band, "px int, py int, seed_id long, dist2 long")
    return out.select("px", "py", F.col("seed_id").cast(kind).alias("seed_id"), "dist2")


def voronoi(seeds: DataFrame, width: int, height: int, padding: int = 0, strategy: str = "auto", n_seeds: int | None = None) -> DataFrame:
    """(px, py, seed_id, dist2) for ranked ``seeds`` (seed_id, x, y).

    ``compare`` tests each pixel against all seeds, which are broadcast; ``transform`` is independent of
    their number. ``auto`` counts them and compares while they are fewer than a canvas row has pixels. More than
    ``MAX_BROADCAST_SEEDS`` seeds are never compared.
    """
    ids = width * height + 1  # ranks and order keys are below
    packs = ids * ((width + 2 * padding) ** 2 + (height + 2 * padding) ** 2) < 1 << 62
    if strategy == "auto":
        n = seeds.count() if n_seeds is None else n_seeds
        strategy = "compare" if packs and n <= min(MAX_BROADCAST_SEEDS, width + 2 * padding) else "transform"
    elif strategy == "compare":
        n = seeds.count() if n_seeds is None else n_seeds
        if n > MAX_BROADCAST_SEEDS:
            raise ValueError(f"{n} seeds are too many to broadcast; use transform")
    elif strategy != "transform":
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "compare" and not packs:
        raise ValueError("the canvas is too large to compare; use transform")
    if strategy == "compare":
        return _by_comparison(seeds, canvas(seeds.sparkSession, width, height, padding), ids)
    return _by_transform(seeds, -padding, -padding, width + 2 * padding, height + 2 * padding)


def nearest_of_both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Update a raster by the raster of added seeds: per pixel the smaller distance, ties to the higher id."""
    key = lambda d, s: F.struct(F.col(d).alias("d"), (-F.col(s)).alias("s"))
    new = new.select("px", "py", F.col("seed_id").alias("n_id"), F.col("dist2").alias("n_d"))
    best = F.least(key("dist2", "seed_id"), key("n_d", "n_id"))
    both = old.join(new, ["px", "py"], "full").select("px", "py", F.coalesce(best, key("dist2", "seed_id"), key("n_d", "n_id")).alias("b"))
    return both.select("px", "py", (-F.col("b.s")).alias("seed_id"), F.col("b.d").alias("dist2"))


def crop(raster: DataFrame, width: int, height: int) -> DataFrame:
    return raster.where(f"px >= 0 AND py >= 0 AND px < {width} AND py < {height}")
