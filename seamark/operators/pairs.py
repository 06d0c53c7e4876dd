"""Pairs of vessels that stay close: what a detector that reads positions one by one would see.

Whenever a vessel reports, it is compared with the latest position of every
other vessel (unless that is stale). A pair is together from its first close
report to the last before one that is not close; if that takes long enough, it
is one transfer. In tables: a position is valid until the vessel's next one, a
close report is a position and a valid one nearby, and two close reports belong
together if the later one is the pair's next report of any kind. That is the
sooner of the next positions of the two that were compared, so reports that
are not close never have to be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.geo import haversine_km
from seamark.operators.joins import near_join


def valid_positions(positions: DataFrame) -> DataFrame:
    """``positions`` (``position_id``, ``vessel_id``, ``at``, ``lat``, ``lon``) with ``next``, the order of the vessel's next one."""
    own = Window.partitionBy("vessel_id").orderBy("at", "position_id")
    return positions.withColumn("next", F.lead(F.struct("at", F.col("position_id").alias("id"))).over(own))


def close_reports(valid: DataFrame, km: float, stale: int, bucket: int = 600_000_000, after: int | None = None) -> DataFrame:
    """Reports within ``km`` of another vessel's latest position, ``stale`` microseconds old at most.

    ``a`` and ``b`` are the vessels by number, ``o`` the report's order, ``end``
    the order of the pair's next report (null: none yet), ``first`` what a
    transfer that begins here is known by. With ``after``, reports later than
    that. A valid position is listed in the time buckets that it spans, so
    that positions meet by cell and bucket; ``stale`` bounds their number.
    """
    at = F.col("at")
    p = valid if after is None else valid.where(at > after)
    p = p.select(F.col("position_id").alias("p_id"), F.col("vessel_id").alias("p_vessel"), at.alias("p_at"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("next").alias("p_next"), F.floor(at / bucket).alias("p_bucket"))
    until = F.least(F.col("next.at"), at + stale)
    q = valid if after is None else valid.where(at + stale >= after)
    q = q.select(F.col("position_id").alias("q_id"), F.col("vessel_id").alias("q_vessel"), at.alias("q_at"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), F.col("next").alias("q_next"), F.explode(F.sequence(F.floor(at / bucket), F.floor(until / bucket))).alias("q_bucket"))
    near = near_join(p, q, km, ("p_lat", "p_lon"), ("q_lat", "q_lon"), same=("p_bucket", "q_bucket"))
    order = F.struct(F.col("p_at").alias("at"), F.col("p_id").alias("id"))
    current = (F.struct(F.col("q_at").alias("at"), F.col("q_id").alias("id")) < order) & (F.col("q_next").isNull() | (F.col("q_next") > order))
    near = near.where((F.col("p_vessel") != F.col("q_vessel")) & current & (F.col("p_at") - F.col("q_at") <= stale))
    near = near.where(haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon")) <= km)
    first = F.struct(F.col("p_at").alias("at"), F.col("p_vessel").alias("vessel_a"), F.col("q_vessel").alias("vessel_b"), ((F.col("p_lat") + F.col("q_lat")) / 2).alias("lat"), ((F.col("p_lon") + F.col("q_lon")) / 2).alias("lon"))
    return near.select(F.least("p_vessel", "q_vessel").alias("a"), F.greatest("p_vessel", "q_vessel").alias("b"), order.alias("o"), F.least("p_next", "q_next").alias("end"), first.alias("first"), "p_id", "q_id")


def together(reports: DataFrame) -> DataFrame:
    """``reports`` with ``began``, the ``first`` of the stretch of reports that each belongs to, and ``stretch``, its number in the pair."""
    pair = Window.partitionBy("a", "b").orderBy("o")
    upto = pair.rowsBetween(Window.unboundedPreceding, 0)
    starts = ~F.coalesce(F.lag("end").over(pair) == F.col("o"), F.lit(False))
    marked = reports.withColumn("starts", starts)
    marked = marked.withColumn("stretch", F.count_if("starts").over(upto))
    return marked.withColumn("began", F.last(F.when(F.col("starts"), F.col("first")), ignorenulls=True).over(upto)).drop("starts")


def transfers(joined: DataFrame, minutes: int) -> DataFrame:
    """One row per stretch of ``together`` reports: the first report ``minutes`` or more after the stretch began."""
    lasted = F.col("o.at") - F.col("began.at")
    rows = joined.where(lasted >= minutes * 60_000_000)
    first = rows.groupBy("a", "b", "stretch").agg(F.min(F.struct("o", "began")).alias("m"))
    return first.select("a", "b", F.col("m.began.vessel_a").alias("vessel_a"), F.col("m.began.vessel_b").alias("vessel_b"), F.col("m.began.at").alias("began_us"), F.col("m.o.at").alias("told_us"), F.col("m.began.lat").alias("lat"), F.col("m.began.lon").alias("lon"))


def lasting_transfers(positions: DataFrame, km: float, stale: int, minutes: int) -> DataFrame:
    """``transfers(together(close_reports(...)), minutes)`` of all ``positions``, without shuffling every close report.

    Each position brings the ones before and after it of its vessel, so that a
    pair of positions shows by itself whether the pair's reports before and
    after it are close. A stretch of one report is left out where it arises,
    and one whose second report comes ``minutes`` or more after its first is
    told there. Only stretches that take more reports to last so long are
    shuffled by pair, up to the report that tells them.
    """
    long, never = minutes * 60_000_000, 1 << 61
    own = Window.partitionBy("vessel_id").orderBy("at", "position_id")
    # plain columns without nulls, as what is compiled for a pair must stay small: a missing time is far away, a missing place no number
    parts = {"at": F.col("at"), "id": F.col("position_id"), "lat": F.col("lat"), "lon": F.col("lon")}
    blank = {"id": F.lit(0).cast("long"), "lat": F.lit(float("nan")), "lon": F.lit(float("nan"))}

    def other(steps: int, prefix: str) -> list[Column]:
        missing = blank | {"at": F.lit(never if steps < 0 else -never)}
        return [F.coalesce(F.lag(c, steps).over(own) if steps else c, missing[n]).alias(f"{prefix}_{n}") for n, c in parts.items()]

    rows = positions.where("at is not null and vessel_id is not null").select("vessel_id", *other(0, "now"), *other(2, "before"), *other(1, "last"), *other(-1, "next"))
    # buckets a quarter as long as vessels are silent: each position is listed in few, and few of a bucket are over
    span, vessels, n = positions.agg(F.max("at") - F.min("at"), F.approx_count_distinct("vessel_id"), F.count("*")).first()
    bucket = int(min(max((span or 0) * vessels / max(n, 1) / 4, 60_000_000), stale))
    p = rows.select(F.col("vessel_id").alias("p_vessel"), *[F.col(f"{x}_{n}").alias(f"{y}_{n}") for x, y in (("now", "p"), ("before", "pb"), ("last", "pl"), ("next", "pn")) for n in parts], F.floor(F.col("now_at") / bucket).alias("p_bucket"))
    until = F.least(F.col("next_at"), F.col("now_at") + stale)
    q = rows.select(F.col("vessel_id").alias("q_vessel"), *[F.col(f"{x}_{n}").alias(f"{y}_{n}") for x, y in (("now", "q"), ("last", "ql"), ("next", "qn")) for n in parts], F.explode(F.sequence(F.floor(F.col("now_at") / bucket), F.floor(until / bucket))).alias("q_bucket"))

    def sooner(x: str, y: str) -> Column:
        return (F.col(f"{x}_at") < F.col(f"{y}_at")) | ((F.col(f"{x}_at") == F.col(f"{y}_at")) & (F.col(f"{x}_id") < F.col(f"{y}_id")))

    def close(x: list[Column], y: list[Column]) -> Column:
        return (F.abs(x[0] - y[0]) <= stale) & (haversine_km(x[1], x[2], y[1], y[2]) <= km)

    def at(x: str) -> list[Column]:
        return [F.col(f"{x}_{n}") for n in ("at", "lat", "lon")]

    def either(condition: Column, x: str, y: str) -> list[Column]:
        return [F.when(condition, a).otherwise(b) for a, b in zip(at(x), at(y), strict=True)]

    near = near_join(p, q, km, ("p_lat", "p_lon"), ("q_lat", "q_lon"), same=("p_bucket", "q_bucket"))
    near = near.where((F.col("p_vessel") != F.col("q_vessel")) & sooner("q", "p") & sooner("p", "qn") & (F.abs(F.col("p_lat") - F.col("q_lat")) <= km / 111.0) & close(at("p"), at("q")))
    # the pair's report before: the later of the reporter's last position and the other one's
    goes_before = close(at("pl"), at("q"))
    # the one after: the sooner of both next positions, beside the latest of the other vessel
    moved = sooner("pn", "qn")
    end_at = F.least("pn_at", "qn_at")
    goes_on = close(either(moved, "pn", "qn"), either(moved, "q", "p"))
    soon = end_at - F.col("p_at") < long
    place = [((F.col(f"p_{n}") + F.col(f"q_{n}")) / 2).alias(n) for n in ("lat", "lon")]
    pair = [F.least("p_vessel", "q_vessel").alias("a"), F.greatest("p_vessel", "q_vessel").alias("b"), F.col("p_vessel").alias("vessel_a"), F.col("q_vessel").alias("vessel_b")]
    told = near.where(~soon & ~goes_before & goes_on).select(*pair, F.col("p_at").alias("began_us"), end_at.alias("told_us"), *place)
    # of the others those that may lead from a first report to the one that tells: the steps before them are short
    turn = sooner("pl", "q")
    x, y = either(turn, "pl", "pb"), either(turn, "ql", "q")
    step = F.greatest("pl_at", "q_at")
    between = F.when(close(x, y), step - F.greatest(x[0], y[0]) < long).otherwise(F.col("p_at") - step < long)
    asked = near.withColumn("starts", ~goes_before).where(F.when(F.col("starts"), soon & goes_on).otherwise(between))
    asked = asked.select(*pair, F.col("p_at").alias("at"), F.col("p_id").alias("id"), end_at.alias("end_at"), F.when(moved, F.col("pn_id")).otherwise(F.col("qn_id")).alias("end_id"), "starts", *[F.when(F.col("starts"), c).alias(n) for c, n in zip(place, ("lat", "lon"), strict=True)])
    by_pair = Window.partitionBy("a", "b").orderBy("at", "id")
    upto = by_pair.rowsBetween(Window.unboundedPreceding, 0)
    linked = (F.lag("end_at").over(by_pair) == F.col("at")) & (F.lag("end_id").over(by_pair) == F.col("id"))
    # what follows neither a first report nor one that does is of a stretch that was told before
    marked = asked.withColumn("new", F.col("starts") | ~F.coalesce(linked, F.lit(False)))
    marked = marked.withColumns({"stretch": F.count_if("new").over(upto), "began": F.last(F.when(F.col("new"), F.struct("starts", "at", "vessel_a", "vessel_b", "lat", "lon")), ignorenulls=True).over(upto)})
    slow = marked.where(F.col("began.starts") & (F.col("at") - F.col("began.at") >= long)).groupBy("a", "b", "stretch").agg(F.min("began").alias("began"), F.min("at").alias("told_us"))
    return told.unionByName(slow.select("a", "b", "began.vessel_a", "began.vessel_b", F.col("began.at").alias("began_us"), "told_us", "began.lat", "began.lon"))
