"""Joins that Spark plans badly when written as plain conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.geo import cell, near_cells
from seamark.tables import micros

#: Spark sizes an exploded side as if it had the rows of its table, so it must not choose to broadcast one.
SHUFFLED = "merge"


def cell_join(left: DataFrame, right: DataFrame, degrees: float, left_on=("lat", "lon"), right_on=("lat", "lon")) -> DataFrame:
    """Pairs of rows whose cells touch: all pairs within ``degrees`` in both axes and some beyond.

    An equi-join on the grid cell. Every left row meets its own cell and the
    eight around it; callers refine by exact distance. Columns of both sides
    must have different names.
    """
    lat, lon = (F.col(c) for c in left_on)
    rlat, rlon = (F.col(c) for c in right_on)
    spread = left.withColumn("_cy", F.explode(near_cells(lat, degrees))).withColumn("_cx", F.explode(near_cells(lon, degrees)))
    held = right.withColumns({"_ry": cell(rlat, degrees), "_rx": cell(rlon, degrees)})
    return spread.hint(SHUFFLED).join(held, (F.col("_cy") == F.col("_ry")) & (F.col("_cx") == F.col("_rx"))).drop("_cy", "_cx", "_ry", "_rx")


def near_join(left: DataFrame, right: DataFrame, km: float, left_on=("lat", "lon"), right_on=("lat", "lon"), times: tuple[str, str, int, int] | None = None, same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs that may lie within ``km``, by equality of grid cells; callers refine by exact distance.

    Cells are twice as high as the radius, so that a left row mostly meets four.
    Towards the poles a radius spans more degrees of longitude, so a left row
    meets as many cells as its latitude asks for, across 180 degrees too.
    ``same`` names a column of each side that must be equal too. With ``times``
    (time columns of both sides, seconds back and ahead) time buckets join the
    key, and pairs are those inside the window. Columns of both sides must have
    different names.
    """
    degrees = km / 111.0
    height = 2 * degrees
    around = int(360 // height) or 1
    width = 360.0 / around
    lat, lon = (F.col(c) for c in left_on)
    rlat, rlon = (F.col(c) for c in right_on)
    edge = F.cos(F.radians(F.least(F.abs(lat) + degrees, F.lit(90.0))))
    reach = F.least(F.lit(degrees) / F.greatest(edge, F.lit(1e-9)), F.lit(180.0)) * 1.01
    rows = F.sequence(cell(lat - degrees, height), cell(lat + degrees, height))
    columns = F.sequence(F.floor((lon + 180.0 - reach) / width).cast("long"), F.floor((lon + 180.0 + reach) / width).cast("long"))
    columns = F.when(2 * reach + 2 * width >= 360, F.sequence(F.lit(0).cast("long"), F.lit(around - 1).cast("long"))).otherwise(columns)
    spread = left.withColumn("_cy", F.explode(rows)).withColumn("_cx", F.explode(columns)).withColumn("_cx", F.pmod(F.col("_cx"), F.lit(around)))
    held = right.withColumns({"_ry": cell(rlat, height), "_rx": F.pmod(F.floor((rlon + 180.0) / width).cast("long"), F.lit(around))})
    meet = (F.col("_cy") == F.col("_ry")) & (F.col("_cx") == F.col("_rx"))
    if same is not None:
        meet = meet & (F.col(same[0]) == F.col(same[1]))
    if times is None:
        return spread.hint(SHUFFLED).join(held, meet).drop("_cy", "_cx", "_ry", "_rx")
    left_ts, right_ts, back, ahead = times
    step = max(1, back + ahead) * 1_000_000
    at, other = micros(left_ts), micros(right_ts)
    buckets = F.sequence(F.floor((at - back * 1_000_000) / step).cast("long"), F.floor((at + ahead * 1_000_000) / step).cast("long"))
    spread, held = spread.withColumn("_b", F.explode(buckets)), held.withColumn("_rb", F.floor(other / step).cast("long"))
    joined = spread.hint(SHUFFLED).join(held, meet & (F.col("_b") == F.col("_rb"))).drop("_cy", "_cx", "_ry", "_rx", "_b", "_rb")
    return joined.where((other >= at - back * 1_000_000) & (other <= at + ahead * 1_000_000))


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, back_seconds: int, ahead_seconds: int = 0, same: tuple[str, str] | None = None) -> DataFrame:
    """Right rows from ``back_seconds`` before to ``ahead_seconds`` after each left row.

    Time is cut into buckets as wide as the window, so each left row meets two
    or three buckets by equality; ``same`` names a column of each side that must
    be equal too.
    """
    width = max(1, back_seconds + ahead_seconds)
    at, other = micros(left_ts), micros(right_ts)
    first = F.floor((at - back_seconds * 1_000_000) / (width * 1_000_000)).cast("long")
    last = F.floor((at + ahead_seconds * 1_000_000) / (width * 1_000_000)).cast("long")
    spread = left.withColumn("_b", F.explode(F.sequence(first, last)))
    held = right.withColumn("_rb", F.floor(other / (width * 1_000_000)).cast("long"))
    meet = F.col("_b") == F.col("_rb")
    if same is not None:
        meet = meet & (F.col(same[0]) == F.col(same[1]))
    joined = spread.hint(SHUFFLED).join(held, meet).drop("_b", "_rb")
    return joined.where((other >= at - back_seconds * 1_000_000) & (other <= at + ahead_seconds * 1_000_000))


def or_join(left: DataFrame, right: DataFrame, conditions: Sequence[Column], key: Sequence[str]) -> DataFrame:
    """Rows that meet any of several equality conditions, each pair once.

    A union of equi-joins instead of a nested loop. ``key`` names the columns
    that identify a pair.
    """
    parts = [left.join(right, c) for c in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(key))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
