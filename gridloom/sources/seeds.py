"""Seed sources and result sinks: sequences, arrays, Parquet tables; dictionaries and arrays out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
SEED = T.StructType([T.StructField("ins_id", T.IntegerType()), *POINT.fields, T.StructField("value", T.DoubleType())])


def seeds_from(spark: SparkSession, seeds: Iterable | np.ndarray | DataFrame, values: Sequence[float] | None = None, first: int = 0) -> DataFrame:
    """(ins_id, x, y, value) from pairs, an (N, 2) array, or a DataFrame that has x and y."""
    if isinstance(seeds, DataFrame):
        value = F.col("value").cast("double") if "value" in seeds.columns else F.lit(None).cast("double")
        order = F.col("ins_id").cast("int") if "ins_id" in seeds.columns else F.lit(None).cast("int")
        return seeds.select(order.alias("ins_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), value.alias("value"))
    if isinstance(seeds, np.ndarray) and (seeds.ndim != 2 or seeds.shape[1] != 2):
        raise ValueError("seeds must be an (N, 2) array")
    rows = [tuple(int(v) for v in p) for p in seeds]
    if any(len(p) != 2 for p in rows):
        raise ValueError("each seed is a pair (x, y)")
    if values is not None and len(values) != len(rows):
        raise ValueError("values and seeds differ in length")
    return spark.createDataFrame([(first + i, x, y, None if values is None else float(values[i])) for i, (x, y) in enumerate(rows)], SEED)


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    return spark.read.parquet(path).select(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))


def to_map(triangles: DataFrame) -> dict[int, tuple[int, int, int, int, int]]:
    """triangle_id -> (x, y, a, b, c), on the driver."""
    return {r[0]: tuple(r)[1:] for r in triangles.select("triangle_id", "x", "y", "a", "b", "c").collect()}


def to_array(triangles: DataFrame) -> np.ndarray:
    """(N, 3) int32, row = triangle_id, on the driver."""
    rows = triangles.select("triangle_id", "a", "b", "c").collect()
    out = np.zeros((len(rows), 3), np.int32)
    for r in rows:
        out[r[0]] = r[1:]
    return out


def to_raster(pixels: DataFrame, width: int, height: int, *names: str) -> np.ndarray:
    """(height, width, len(names)) int32 from (px, py, names), on the driver."""
    out = np.zeros((height, width, len(names)), np.int32)
    pdf = pixels.select("px", "py", *names).toPandas()
    out[pdf["py"], pdf["px"]] = pdf[list(names)].to_numpy()
    return out
