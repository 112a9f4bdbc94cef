"""Metric and latency aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENCY_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0)


def counters(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def gauges(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("value"))


def histogram(df: DataFrame, keys: list[str], value: str, bounds=LATENCY_BOUNDS) -> DataFrame:
    """Cumulative buckets, sum and count of each key, a row per bucket; the last bound is infinity."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in bounds], F.count(value).alias("le_inf"), F.sum(value).alias("sum"))
    return wide.unpivot([*keys, "sum"], [F.col(f"`le_{b:g}`") for b in bounds] + [F.col("le_inf")], "bucket", "count")


def exposition(hist: DataFrame, metric: str, key: str) -> DataFrame:
    """Lines of the text format of metric scrapers for a histogram with one label."""
    le = F.regexp_replace(F.regexp_replace("bucket", "^le_", ""), "^inf$", "+Inf")
    return hist.select(F.format_string(f'{metric}_bucket{{{key}="%s",le="%s"}} %d', F.col(key), le, F.col("count")).alias("value"))
