"""Answers as they arrive: the engines' counts kept up to date. An extension; rates are stateless projections on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats


def deduplicated(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Re-deliveries of an answer count once; state older than the watermark is dropped."""
    return stream.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["answer_id"])


def mention_counts(stream: DataFrame, needle: str, lateness: str = "1 day") -> DataFrame:
    """engine, c, n for update or complete mode."""
    rows = deduplicated(stream, lateness).where(~F.coalesce("params.no_fixture", F.lit(False)))
    return rows.groupBy("engine").agg(F.count_if(F.contains(F.lower("answer_text"), F.lit(needle.lower()))).alias("c"), F.count("*").alias("n"))


def rates(counts: DataFrame) -> DataFrame:
    return counts.select("engine", *stats.metric("mention", F.col("c"), F.col("n")))
