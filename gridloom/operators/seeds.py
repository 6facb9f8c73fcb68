"""Seeds: validation, ranking, getters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranking import with_rank


def check_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ValueError(f"width and height must be positive, got {width} x {height}")


def duplicate_seeds(seeds: DataFrame) -> DataFrame:
    """(x, y, n) of the places with more than one seed."""
    return seeds.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def seeds_outside(seeds: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y) of seeds that are not on the image."""
    return seeds.where(f"x < 0 OR y < 0 OR x >= {width} OR y >= {height}").select("x", "y")


def validate_seeds(seeds: DataFrame, width: int, height: int) -> None:
    """Raise ValueError for an empty set, seeds outside the image, or two seeds in one place."""
    check_size(width, height)
    n, nulls, x0, x1, y0, y1 = seeds.agg(F.count(F.lit(1)), F.count_if(F.col("x").isNull() | F.col("y").isNull()), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no seeds")
    if nulls:
        raise ValueError("a seed has no coordinates")
    if x0 < 0 or y0 < 0 or x1 >= width or y1 >= height:
        raise ValueError(f"seeds outside {width} x {height}: x {x0}..{x1}, y {y0}..{y1}")
    twice = duplicate_seeds(seeds).first()
    if twice is not None:
        raise ValueError(f"duplicate seed at ({twice['x']}, {twice['y']})")


def rank_seeds(seeds: DataFrame) -> DataFrame:
    """Adds seed_id, the rank by (x, y). A column of the image is a bucket, so no task sorts all seeds."""
    return with_rank(seeds, F.col("x"), ("x", "y"), "seed_id")
