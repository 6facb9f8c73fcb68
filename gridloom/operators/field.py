"""Edges of a triangulation, their scores over a scalar field, and the midpoints that refine it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import squared_distance
from gridloom.operators.ranking import with_rank
from gridloom.operators.topology import RANK_BUCKET


def edges(triangles: DataFrame) -> DataFrame:
    """(edge_idx, a, b): distinct undirected edges, a < b, in order of (a, b)."""
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))
    one = triangles.select(F.explode(pairs).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
    return with_rank(one, (F.col("a") / RANK_BUCKET).cast("int"), ("a", "b"), "edge_idx").select("edge_idx", "a", "b")


def _ends(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    for name in "ab":
        edges = edges.join(seeds.select(F.col("seed_id").alias(name), F.col("x").alias(name + "x"), F.col("y").alias(name + "y"), F.col("value").cast("float").cast("double").alias(name + "v")), name)
    return edges


def edge_scores(edges: DataFrame, seeds: DataFrame, min_length: float = 0.0) -> DataFrame:
    """Adds score, the change of the value times the length, or 0 for edges shorter than ``min_length``; and the ends.

    Values are single precision, the product is taken in double and stored as single again, so scores that differ
    beyond single precision are equal.
    """
    ends = _ends(edges, seeds)
    d2 = squared_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    score = F.abs(F.col("bv") - F.col("av")) * F.sqrt(d2.cast("double"))
    return ends.withColumn("score", F.when(d2 < min_length * min_length, 0.0).otherwise(score).cast("float"))


def select_midpoints(edges: DataFrame, seeds: DataFrame, width: int, height: int, min_length: float, count: int, threshold: float = 0.0) -> DataFrame:
    """(x, y) of the midpoints of the ``count`` best edges that score above ``threshold``, ordered by (y, x).

    Midpoints round half to even and stay on the image; those on a seed go, and of several on one pixel one
    is left. Ties of the score go to the lower edge index.
    """
    best = edge_scores(edges, seeds, min_length).where(F.col("score") > F.lit(max(threshold, 0.0)).cast("float")).orderBy(F.desc("score"), "edge_idx").limit(count)
    mid = lambda k, top: F.greatest(F.least(F.rint((F.col(f"a{k}") + F.col(f"b{k}")) / 2).cast("int"), F.lit(top - 1)), F.lit(0))
    at = best.select(mid("x", width).alias("x"), mid("y", height).alias("y")).distinct()
    return at.join(seeds.select("x", "y"), ["x", "y"], "left_anti").orderBy("y", "x")
