"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.lineage import cut

__all__ = ["cut", "rank_within"]

BUCKETS = 64


def rank_within(df: DataFrame, group: list[str], key: str, order: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds rank (from 0) within ``group``, by ``order`` (a number of few values) and then by a hash of ``key``.

    A group is ranked bucket by bucket: counts per (group, order, bucket) give each bucket its offset, so that no task
    sees more than a bucket of a group, and only counts are ordered group by group.
    """
    o = F.lit(0).cast("long") if order is None else order
    d = df.withColumn("_o", o).withColumn("_h", F.xxhash64(key)).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    at = [*group, "_o", "_b"]
    counts = d.groupBy(*at).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_o", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("_h", key)) - 1
    return d.withColumn("_r", inside).join(offsets, at).withColumn("rank", F.col("_off") + F.col("_r")).drop("_o", "_h", "_b", "_off", "_r")
