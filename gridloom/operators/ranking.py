"""Gapless ranks without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_rank(df: DataFrame, bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds the 0-based rank by ``order``; ``bucket`` must not decrease along that order.

    Rows are counted by bucket, the counts are summed along the buckets (one short row each), and rows are
    numbered within their bucket.
    """
    df = df.withColumn("_bucket", bucket)
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    out = df.join(starts, "_bucket").withColumn(name, (F.col("_start") + F.row_number().over(within) - 1).cast("int"))
    return out.drop("_bucket", "_start")
