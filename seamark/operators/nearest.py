"""The nearest row on the sphere, at any distance.

Right rows are held in cells of latitude and longitude, each level four times
as wide as the one below, up to one cell for the whole sphere; a level has one
row per occupied cell, with its bounds and one of its points. A left row looks
at its cell and the eight around it, level by level, until one is occupied: the
distance to the point found bounds the search. Then it takes the cells that the
circle of that bound touches, at a level where these are few, and goes down
level by level: cells that lie farther than the best point so far are left out,
and points of the others lower the bound. Only points of the last cells are
compared one by one, so that a far row does not meet all points of a crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.geo import EARTH_KM, haversine_km
from seamark.operators.graph import ensure_checkpoint_dir

#: Kilometres added to bounds, so that rounding never leaves out a nearest point.
SLACK_KM = 1e-4


def _widths(degrees: float) -> list[float]:
    out = [degrees]
    while out[-1] < 360:
        out.append(out[-1] * 4)
    return out


def _lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _least_km(lat: Column, lon: Column) -> Column:
    """No point of the cell (``south``, ``north``, ``west``, ``east``) is nearer: the distance to its parallels and to its meridians."""
    dlat = F.greatest(F.lit(0.0), F.col("south") - lat, lat - F.col("north"))
    apart = F.least(F.pmod(F.col("west") - lon, F.lit(360.0)), F.pmod(lon - F.col("east"), F.lit(360.0)))
    inside = (lon >= F.col("west")) & (lon <= F.col("east"))
    dlon = F.when(inside, 0.0).otherwise(F.least(apart, F.lit(90.0)))
    return EARTH_KM * F.greatest(F.radians(dlat), F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(dlon)))))


def _cells(points: DataFrame, levels: int) -> list[DataFrame]:
    """Occupied cells of each level: ``cy``, ``cx``, bounds, and ``p``, the point of the smallest id."""
    bounds = [F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"), F.min("p").alias("p")]
    at = points.select("cy", "cx", F.col("r_lat").alias("south"), F.col("r_lat").alias("north"), F.col("r_lon").alias("west"), F.col("r_lon").alias("east"), F.struct("r_id", "r_lat", "r_lon").alias("p"))
    out = [at.groupBy("cy", "cx").agg(*bounds).checkpoint()]
    for _ in range(1, levels):
        above = out[-1].withColumns({"cy": F.shiftright("cy", 2), "cx": F.shiftright("cx", 2)})
        out.append(above.groupBy("cy", "cx").agg(*bounds).checkpoint())
    return out


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_on: tuple[str, str] = ("lat", "lon"), right_on: tuple[str, str] = ("lat", "lon"), degrees: float = 0.05) -> DataFrame:
    """Per row of ``left``: ``left_id``, ``nearest_id``, ``km``.

    Distances are compared to the millimetre; of equally near rows the one with
    the smallest id is taken. ``left_id`` must be unique. Right rows without
    coordinates are left out; a left row without them, or any left row if no
    right row is left, gets nulls. ``degrees`` is the width of the smallest
    cells: about as wide as holds a few points.
    """
    ensure_checkpoint_dir(left.sparkSession)
    widths = _widths(degrees)
    rlat, rlon = F.col(right_on[0]), F.col(right_on[1])
    held = right.where(rlat.isNotNull() & rlon.isNotNull()).select(F.col(right_id).alias("r_id"), rlat.cast("double").alias("r_lat"), _lon(rlon).alias("r_lon"))
    held = held.groupBy("r_lat", "r_lon").agg(F.min("r_id").alias("r_id"))
    held = held.withColumns({"cy": F.floor((F.col("r_lat") + 90.0) / degrees), "cx": F.floor((F.col("r_lon") + 180.0) / degrees)}).checkpoint()
    cells = _cells(held, len(widths))
    lat, lon = F.col("l_lat"), F.col("l_lon")
    rows = left.select(F.col(left_id).alias("l_id"), F.col(left_on[0]).cast("double").alias("l_lat"), _lon(F.col(left_on[1])).alias("l_lon"))
    to_point = haversine_km(lat, lon, F.col("p.r_lat"), F.col("p.r_lon"))

    # widening rings: until an occupied cell bounds the distance
    bounded: DataFrame | None = None
    open_rows = rows.where(lat.isNotNull() & lon.isNotNull())
    for width, level in zip(widths, cells, strict=True):
        columns = max(1, int(-(-360 // width)))
        cy, cx = F.floor((lat + 90.0) / width), F.floor((lon + 180.0) / width)
        around = F.array_distinct(F.transform(F.array(*[cx + o for o in (-1, 0, 1)]), lambda c: F.pmod(c, F.lit(columns))))
        near = open_rows.withColumn("cy", F.explode(F.array(*[cy + o for o in (-1, 0, 1)]))).withColumn("cx", F.explode(around))
        best = near.join(level.select("cy", "cx", "p"), ["cy", "cx"]).groupBy("l_id").agg(F.min(to_point).alias("reach"))
        met = open_rows.join(best, "l_id", "left").checkpoint()
        found = met.where("reach is not null")
        bounded = found if bounded is None else bounded.unionByName(found)
        open_rows = met.where("reach is null").drop("reach")
        if open_rows.isEmpty():
            break
    if bounded is None:
        bounded = open_rows.withColumn("reach", F.lit(0.0))

    # the cells that the circle touches, at the first level where it spans about one
    bounded = bounded.withColumn("reach", F.col("reach") + SLACK_KM)
    up = F.degrees(F.col("reach") / EARTH_KM)
    over_pole = F.abs(lat) + up >= 89.999
    side = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(up, F.lit(90.0)))) / F.cos(F.radians(lat))))))
    bounded = bounded.withColumns({"up": up * 1.000001 + 1e-9, "side": F.least(F.lit(180.0), side * 1.000001 + 1e-9)})
    level_of = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        level_of = F.when(F.greatest("up", "side") <= widths[k], k).otherwise(level_of)
    bounded = bounded.withColumn("level", level_of)

    def touched(k: int) -> DataFrame:
        width = widths[k]
        columns = max(1, int(-(-360 // width)))
        ys = F.sequence(F.floor((lat - F.col("up") + 90.0) / width), F.floor((lat + F.col("up") + 90.0) / width))
        # the last column may be narrower than the others, so one more is looked at beyond it
        xs = F.sequence(F.floor((lon - F.col("side") + 180.0) / width) - 1, F.floor((lon + F.col("side") + 180.0) / width) + 1)
        xs = F.array_distinct(F.transform(xs, lambda c: F.pmod(c, F.lit(columns))))
        own = bounded.where(F.col("level") == k)
        return own.withColumn("cy", F.explode(ys)).withColumn("cx", F.explode(xs)).select("l_id", "l_lat", "l_lon", "reach", "cy", "cx")

    waiting = touched(len(widths) - 1)
    for k in range(len(widths) - 1, 0, -1):
        children = cells[k - 1].withColumns({"uy": F.shiftright("cy", 2), "ux": F.shiftright("cx", 2)})
        down = waiting.withColumnsRenamed({"cy": "uy", "cx": "ux"}).join(children, ["uy", "ux"])
        down = down.withColumns({"d": to_point + SLACK_KM, "least": _least_km(lat, lon)}).where("least <= reach")
        down = down.withColumn("reach", F.least("reach", F.min("d").over(Window.partitionBy("l_id")))).where("least <= reach")
        waiting = down.select("l_id", "l_lat", "l_lon", "reach", "cy", "cx").unionByName(touched(k - 1)).checkpoint()
    km = F.round(haversine_km(lat, lon, F.col("r_lat"), F.col("r_lon")), 6)
    best = waiting.join(held, ["cy", "cx"]).groupBy("l_id").agg(F.min(F.struct(km.alias("km"), "r_id")).alias("b"))
    return rows.join(best, "l_id", "left").select(F.col("l_id").alias(left_id), F.col("b.r_id").alias("nearest_id"), F.col("b.km").alias("km"))
