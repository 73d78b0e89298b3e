"""Rates with their count, denominator and Wilson interval, as column expressions.

A rate that can't be measured is a status with null numbers, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
MINIMUM_N = 10  # smaller denominators are flagged


def wilson(count: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound; null unless 0 <= count <= n and n > 0. Bounds are not clamped."""
    ok = (n > 0) & (count >= 0) & (count <= n)
    size = F.when(ok, n).cast("double")
    p = count / size
    scale = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return centre - half, centre + half


def metric(prefix: str, count: Column, n: Column, when_empty: str | Column = "no_data", digits: int | None = 6) -> list[Column]:
    """prefix_count, prefix_n, prefix_rate, prefix_low, prefix_high, prefix_status."""
    there = n > 0
    empty = when_empty if isinstance(when_empty, Column) else F.lit(when_empty)
    low, high = wilson(count, n)
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [
        F.when(there, count).cast("long").alias(f"{prefix}_count"),
        n.cast("long").alias(f"{prefix}_n"),
        cut(F.when(there, count / F.when(there, n))).alias(f"{prefix}_rate"),
        cut(low).alias(f"{prefix}_low"),
        cut(high).alias(f"{prefix}_high"),
        F.when(~there, empty).when(n >= MINIMUM_N, F.lit("ok")).otherwise("low_sample").alias(f"{prefix}_status"),
    ]


def metric_text(count: Column, n: Column, status: Column) -> Column:
    """'4 of 9 (44%, 95% CI 19%–73%) · low sample'; a status without numbers is given in words."""
    low, high = wilson(count, n)
    pct = lambda c: F.concat(F.round(100 * c, 0).cast("int").cast("string"), F.lit("%"))
    body = F.concat(count.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" ("), pct(count / F.when(n > 0, n)), F.lit(", 95% CI "), pct(F.abs(low)), F.lit("–"), pct(high), F.lit(")"), F.when(status == "low_sample", " · low sample").otherwise(""))
    return F.when(n > 0, body).otherwise(F.regexp_replace(status, "_", " "))
