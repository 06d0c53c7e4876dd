"""Windows over time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.tables import micros


def rolling_z(df: DataFrame, key: str, order: str, value: str, size: int, current: bool = True, out: str = "z") -> DataFrame:
    """Adds the z-score of ``value`` against a window of ``size`` rows.

    The window ends with the row itself, or with the row before it. Null where
    the window is not full or its (sample) deviation is 0.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1) if current else -size, 0 if current else -1)
    full = F.count(value).over(w) == size
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.when(full & (sd > 1e-12), (F.col(value) - F.avg(value).over(w)) / sd))


def decayed(confidence: Column, at: Column, as_of: str, rate: float = 0.02) -> Column:
    """Exponential decay by age in days; the base where the time is missing."""
    age = F.greatest((micros(F.lit(as_of)) - micros(at)) / 86_400_000_000.0, F.lit(0.0))
    return F.coalesce(confidence * F.pow(F.lit(1.0 - rate), age), confidence)


def day_spine(df: DataFrame, ts: str) -> DataFrame:
    """Every day from the first to the last of ``ts``."""
    ends = df.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))
