"""Queries over tracks and time series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamark import tables as T
from seamark.functions.geo import haversine_km, haversine_sql
from seamark.operators import alerts, joins, series
from seamark.plans.registry import query
from seamark.tables import micros, with_views

GAPS = f"""gaps AS (
    SELECT *, {haversine_sql("last_lat", "last_lon", "lat", "lon")} AS km, km / (hours * 1.852) AS implied_kts FROM (
        SELECT vessel_id, position_id, ts, lat, lon, speed_kts, nav_status, lag(ts) OVER w AS last_ts, lag(lat) OVER w AS last_lat, lag(lon) OVER w AS last_lon,
               lag(speed_kts) OVER w AS last_speed, lag(nav_status) OVER w AS last_nav, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000.0::DOUBLE AS hours
        FROM positions WINDOW w AS (PARTITION BY vessel_id ORDER BY ts, position_id))
    WHERE hours >= 6),
caused AS (
    SELECT *, CASE WHEN last_nav IN (1, 5) AND km < 1 THEN 'TECHNICAL_FAILURE_ANCHORED' WHEN last_speed > 5 AND km > 50 THEN 'AIS_OFF_DELIBERATE'
               WHEN hours > 24 AND km > 100 THEN 'AIS_OFF_DELIBERATE' WHEN implied_kts > 3 AND implied_kts < 20 THEN 'COVERAGE_GAP' WHEN implied_kts > 40 THEN 'SPOOFING_SUSPECTED' ELSE 'UNKNOWN' END AS cause,
           CASE WHEN hours >= 24 THEN 'CRITICAL' WHEN hours >= 12 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, hours >= 12 OR implied_kts > 5 AS risk_flag
    FROM gaps)"""


def gaps_sql(body: str) -> str:
    return with_views("positions", f"WITH {GAPS} {body}")


def gap_cause(nav, speed, km, hours, implied):
    """The ladder of probable causes; the first rung that fits decides."""
    return (
        F.when(nav.isin(1, 5) & (km < 1), "TECHNICAL_FAILURE_ANCHORED")
        .when((speed > 5) & (km > 50), "AIS_OFF_DELIBERATE")
        .when((hours > 24) & (km > 100), "AIS_OFF_DELIBERATE")
        .when((implied > 3) & (implied < 20), "COVERAGE_GAP")
        .when(implied > 40, "SPOOFING_SUSPECTED")
        .otherwise("UNKNOWN")
    )


def detect_gaps(track, min_hours: float = 6.0):
    """Gaps between consecutive positions of a vessel, with displacement, cause, severity and flag."""
    w = Window.partitionBy("vessel_id").orderBy("ts", "position_id")
    last = F.lag(F.struct("ts", "lat", "lon", "speed_kts", "nav_status")).over(w)
    g = track.withColumn("last", last).withColumn("hours", (micros("ts") - micros("last.ts")) / 3_600_000_000.0).where(F.col("hours") >= min_hours)
    g = g.withColumn("km", haversine_km(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon")))
    g = g.withColumn("implied_kts", F.col("km") / (F.col("hours") * 1.852))
    return g.withColumns({
        "cause": gap_cause(F.col("last.nav_status"), F.col("last.speed_kts"), F.col("km"), F.col("hours"), F.col("implied_kts")),
        "severity": F.when(F.col("hours") >= 24, "CRITICAL").when(F.col("hours") >= 12, "HIGH").otherwise("MEDIUM"),
        "risk_flag": (F.col("hours") >= 12) | (F.col("implied_kts") > 5),
    })


@query(gaps_sql("SELECT position_id, vessel_id, last_ts AS gap_start, ts AS gap_end, round(hours, 4) AS hours, round(km, 4) AS km, round(implied_kts, 4) AS implied_kts, cause, severity, risk_flag FROM caused"))
def gap_events(spark, d):
    g = detect_gaps(T.positions(spark, d))
    return g.select("position_id", "vessel_id", F.col("last.ts").alias("gap_start"), F.col("ts").alias("gap_end"), *[F.round(c, 4).alias(c) for c in ("hours", "km", "implied_kts")], "cause", "severity", "risk_flag")


@query(gaps_sql("SELECT cause, count(*) AS n, round(avg(hours), 4) AS mean_hours, count(*) FILTER (risk_flag) AS flagged, round(max(km), 4) AS max_km FROM caused GROUP BY 1 ORDER BY n DESC, cause"))
def gap_summary(spark, d):
    """The flagship query: AIS gaps by probable cause."""
    g = detect_gaps(T.positions(spark, d))
    out = g.groupBy("cause").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 4).alias("mean_hours"), F.count_if("risk_flag").alias("flagged"), F.round(F.max("km"), 4).alias("max_km"))
    return out.orderBy(F.desc("n"), "cause")


@query(with_views("positions", """
    WITH m AS (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM positions WINDOW w AS (PARTITION BY vessel_id ORDER BY ts ROWS 29 PRECEDING))
    SELECT position_id, vessel_id, round((value - mu) / sd, 4) AS z, CASE WHEN abs((value - mu) / sd) >= 3.5 THEN 4 ELSE 3 END AS severity FROM m WHERE n = 30 AND sd > 1e-12 AND abs((value - mu) / sd) >= 2.5"""))
def rolling_z_market(spark, d):
    """Windows of 30 that include the row."""
    z = series.rolling_z(T.positions(spark, d), "vessel_id", "ts", "value", 30).where(F.abs("z") >= 2.5)
    return z.select("position_id", "vessel_id", F.round("z", 4).alias("z"), F.when(F.abs("z") >= 3.5, 4).otherwise(3).alias("severity"))


@query(with_views("positions", """
    WITH m AS (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM positions WINDOW w AS (PARTITION BY vessel_id ORDER BY ts ROWS 59 PRECEDING)),
    a AS (SELECT vessel_id, position_id, ts, (value - mu) / sd AS z FROM m WHERE n = 60 AND sd > 1e-12 AND abs((value - mu) / sd) >= 2.5)
    SELECT vessel_id, position_id, round(z, 4) AS z FROM a QUALIFY row_number() OVER (PARTITION BY vessel_id ORDER BY ts DESC) = 1"""))
def rolling_z_latest(spark, d):
    """Windows of 60; only the latest anomaly of a series."""
    z = series.rolling_z(T.positions(spark, d), "vessel_id", "ts", "value", 60).where(F.abs("z") >= 2.5)
    return z.groupBy("vessel_id").agg(F.max_by(F.struct("position_id", "z"), "ts").alias("m")).select("vessel_id", "m.position_id", F.round("m.z", 4).alias("z"))


@query(with_views("positions", """
    WITH m AS (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM positions WINDOW w AS (PARTITION BY vessel_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
    SELECT position_id, round((value - mu) / sd, 4) AS z, least(10, floor(2 * (value - mu) / sd))::BIGINT AS severity FROM m WHERE n = 12 AND sd > 1e-12 AND (value - mu) / sd >= 2.0"""))
def price_spikes(spark, d):
    """The previous 12 rows, one-sided."""
    z = series.rolling_z(T.positions(spark, d), "vessel_id", "ts", "value", 12, current=False).where("z >= 2.0")
    return z.select("position_id", F.round("z", 4).alias("z"), F.least(F.lit(10), F.floor(2 * F.col("z"))).cast("long").alias("severity"))


@query(with_views("positions", """
    WITH r AS (SELECT vessel_id, position_id, value / lag(value) OVER (PARTITION BY vessel_id ORDER BY ts, position_id) - 1 AS ret FROM positions WHERE value > 0),
    s AS (SELECT vessel_id, avg(ret) AS mu, stddev_samp(ret) AS sd, count(ret) AS n FROM r GROUP BY 1)
    SELECT position_id, round((ret - mu) / sd, 4) AS z FROM r JOIN s USING (vessel_id) WHERE n >= 20 AND sd > 0 AND abs((ret - mu) / sd) > 2.5"""))
def return_outliers(spark, d):
    """Returns against the whole series; strictly above 2.5 deviations."""
    w = Window.partitionBy("vessel_id").orderBy("ts", "position_id")
    r = T.positions(spark, d).where("value > 0").withColumn("ret", F.col("value") / F.lag("value").over(w) - 1)
    s = r.groupBy("vessel_id").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n")).where("n >= 20 and sd > 0")
    z = (F.col("ret") - F.col("mu")) / F.col("sd")
    return r.join(s, "vessel_id").where(F.abs(z) > 2.5).select("position_id", F.round(z, 4).alias("z"))


@query("""
    WITH t AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM t),
    g AS (SELECT event_type, avg(v) FILTER (rn <= n * 7 // 30) AS recent, avg(v) FILTER (rn > n * 7 // 30) AS before, stddev_pop(v) FILTER (rn > n * 7 // 30) AS sd, max(n) AS n FROM n GROUP BY 1)
    SELECT event_type, n, round(recent, 4) AS recent, round(before, 4) AS before, round((recent - before) / sd, 4) AS z, abs((recent - before) / sd) > 2 AS shifted FROM g WHERE n >= 8 AND sd > 0""")
def narrative_shift(spark, d):
    """The last 7 of 30 days of a series against what came before, by population deviation."""
    t = T.load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    key = Window.partitionBy("event_type")
    t = t.withColumns({"rn": F.row_number().over(key.orderBy(F.desc("day"))), "n": F.count("*").over(key)})
    late = F.col("rn") <= F.floor(F.col("n") * 7 / 30)
    g = t.groupBy("event_type").agg(F.max("n").alias("n"), F.avg(F.when(late, F.col("v"))).alias("recent"), F.avg(F.when(~late, F.col("v"))).alias("before"), F.stddev_pop(F.when(~late, F.col("v"))).alias("sd")).where("n >= 8 and sd > 0")
    z = (F.col("recent") - F.col("before")) / F.col("sd")
    return g.select("event_type", "n", F.round("recent", 4).alias("recent"), F.round("before", 4).alias("before"), F.round(z, 4).alias("z"), (F.abs(z) > 2).alias("shifted"))


@query(with_views("positions", f"""
    WITH h AS (SELECT *, (position_id * 47 % 360)::DOUBLE AS track FROM positions),
    t AS (SELECT *, lag(track) OVER (PARTITION BY vessel_id ORDER BY ts, position_id) AS last_track, row_number() OVER (PARTITION BY vessel_id ORDER BY ts DESC, position_id DESC) AS rn FROM h QUALIFY rn <= 200),
    u AS (SELECT *, abs(track - last_track) AS raw FROM t),
    c AS (SELECT vessel_id, avg(lat) AS clat, avg(lon) AS clon, count(*) AS points, count(*) FILTER (CASE WHEN raw > 180 THEN 360 - raw ELSE raw END > 60) AS turns FROM u GROUP BY 1),
    m AS (SELECT u.vessel_id, max({haversine_sql("u.lat", "u.lon", "clat", "clon")} / 1.852) AS radius_nm FROM u JOIN c ON c.vessel_id = u.vessel_id GROUP BY 1)
    SELECT vessel_id, points, turns, round(radius_nm, 3) AS radius_nm, round(least(0.95, 0.5 + 0.05 * turns), 4) AS confidence FROM c JOIN m USING (vessel_id) WHERE points >= 6 AND turns >= 3 AND radius_nm <= 45"""))
def orbits(spark, d):
    """Circling tracks: many sharp turns close to the mean position, over the last 200 points."""
    p = T.positions(spark, d).withColumn("track", (F.col("position_id") * 47 % 360).cast("double"))
    w = Window.partitionBy("vessel_id")
    p = joins.top_per_key(p, ["vessel_id"], [F.desc("ts"), F.desc("position_id")], 200).withColumn("raw", F.abs(F.col("track") - F.lag("track").over(w.orderBy("ts", "position_id"))))
    turn = F.when(F.col("raw") > 180, 360 - F.col("raw")).otherwise(F.col("raw")) > 60
    c = p.groupBy("vessel_id").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.count("*").alias("points"), F.count_if(turn).alias("turns")).where("points >= 6 and turns >= 3")
    far = p.join(c, "vessel_id").groupBy("vessel_id").agg(F.first("points").alias("points"), F.first("turns").alias("turns"), F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) / 1.852).alias("r"))
    return far.where("r <= 45").select("vessel_id", "points", "turns", F.round("r", 3).alias("radius_nm"), F.round(F.least(F.lit(0.95), 0.5 + 0.05 * F.col("turns")), 4).alias("confidence"))


@query("""
    WITH m AS (SELECT o_custkey % 50 AS area, date_trunc('month', o_orderdate)::DATE AS month, (count(*) % 5 + 1)::INT AS phase FROM orders GROUP BY ALL)
    SELECT area, month::VARCHAR AS month, phase, previous FROM (SELECT *, lag(phase) OVER (PARTITION BY area ORDER BY month) AS previous, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS rn FROM m)
    WHERE rn = 1 AND phase > previous AND previous >= 2""")
def phase_escalation(spark, d):
    """Areas whose last phase rose above the one before."""
    o = T.load(spark, d, "orders")
    m = o.groupBy((F.col("o_custkey") % 50).alias("area"), F.trunc("o_orderdate", "month").alias("month")).agg((F.count("*") % 5 + 1).cast("int").alias("phase"))
    two = m.groupBy("area").agg(F.max(F.struct("month", "phase")).alias("last"), F.slice(F.sort_array(F.collect_list(F.struct("month", "phase")), False), 2, 1)[0].alias("prev"))
    return two.select("area", F.col("last.month").cast("string").alias("month"), F.col("last.phase").alias("phase"), F.col("prev.phase").alias("previous")).where("phase > previous and previous >= 2")


@query("""
    WITH s AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day),
    a AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT day::VARCHAR AS day, coalesce(a.n, 0) AS causes, coalesce(b.n, 0) AS effects FROM s LEFT JOIN a USING (day) LEFT JOIN b USING (day)""")
def daily_spine(spark, d):
    """Zero-filled daily counts of two kinds of event."""
    e = T.load(spark, d, "events")

    def count(kind, name):
        return e.where((F.col("event_type") == kind)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias(name))

    return series.day_spine(e, "ts").join(count("error", "causes"), "day", "left").join(count("purchase", "effects"), "day", "left").fillna(0).withColumn("day", F.col("day").cast("string"))


@query("""
    WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS month, avg(l_discount) * 10 + 1e-9 AS strength FROM lineitem GROUP BY ALL)
    SELECT c.l_suppkey AS edge_id, c.month::VARCHAR AS month, round(c.strength, 4) AS strength, CASE WHEN p.strength IS NULL THEN 'NEW' WHEN c.strength > p.strength + 0.05 THEN 'STRENGTHENING'
           WHEN c.strength < p.strength - 0.05 THEN 'WEAKENING' ELSE 'STABLE' END AS trend
    FROM m c LEFT JOIN m p ON p.l_suppkey = c.l_suppkey AND p.month = (c.month - INTERVAL 12 MONTH)::DATE WHERE c.month >= DATE '2000-01-01'""")
def edge_trend(spark, d):
    """Monthly strengths against those of a year before."""
    m = T.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("edge_id"), F.trunc("l_shipdate", "month").alias("month")).agg((F.avg("l_discount") * 10 + 1e-9).alias("strength"))
    past = m.select(F.col("edge_id").alias("p_edge"), F.add_months("month", 12).alias("p_month"), F.col("strength").alias("was"))
    now = m.where("month >= date'2000-01-01'").join(past, (F.col("edge_id") == F.col("p_edge")) & (F.col("month") == F.col("p_month")), "left")
    trend = F.when(F.col("was").isNull(), "NEW").when(F.col("strength") > F.col("was") + 0.05, "STRENGTHENING").when(F.col("strength") < F.col("was") - 0.05, "WEAKENING").otherwise("STABLE")
    return now.select("edge_id", F.col("month").cast("string").alias("month"), F.round("strength", 4).alias("strength"), trend.alias("trend"))


YEARLY = """y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def yearly(spark, d):
    o, c = T.load(spark, d, "orders"), T.load(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))


@query(f"""
    WITH {YEARLY}, i AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY year) AS idx FROM y)
    SELECT nation, count(*) AS years, round(regr_slope(total, idx), 2) AS slope, max_by(total, year) > 1.2 * avg(total) AND regr_slope(total, idx) > 0 AS rising FROM i GROUP BY 1 HAVING count(*) >= 3""")
def yearly_slope(spark, d):
    """Least-squares trend of yearly totals."""
    i = yearly(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("nation").orderBy("year")))
    g = i.groupBy("nation").agg(F.count("*").alias("years"), F.regr_slope("total", "idx").alias("s"), F.max_by("total", "year").alias("last"), F.avg("total").alias("mean")).where("years >= 3")
    return g.select("nation", "years", F.round("s", 2).alias("slope"), ((F.col("last") > 1.2 * F.col("mean")) & (F.col("s") > 0)).alias("rising"))


@query(f"""
    WITH {YEARLY} SELECT a.nation, a.year, b.year AS base_year, round(a.total / b.total - 1, 4) AS growth FROM y a JOIN y b ON a.nation = b.nation AND b.year < a.year WHERE a.total >= 1.25 * b.total AND b.total > 0""")
def yearly_surge(spark, d):
    """Years at least a quarter above an earlier year."""
    y = yearly(spark, d)
    b = y.select("nation", F.col("year").alias("base_year"), F.col("total").alias("base"))
    return y.join(b, "nation").where("base_year < year and total >= 1.25 * base and base > 0").select("nation", "year", "base_year", F.round(F.col("total") / F.col("base") - 1, 4).alias("growth"))


@query("""
    WITH g AS (SELECT c_nationkey AS nation, avg(c_acctbal) FILTER (c_mktsegment = 'AUTOMOBILE') AS gdp, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS inflation,
                      avg(c_acctbal) FILTER (c_mktsegment = 'FURNITURE') AS fx, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0) AS unemployment FROM customer GROUP BY 1)
    SELECT nation, round((coalesce(.30 * gdp, 0) + coalesce(.25 * inflation, 0) + coalesce(.20 * fx, 0) + coalesce(.15 * unemployment, 0)) /
           nullif(CASE WHEN gdp IS NULL THEN 0 ELSE .30 END + CASE WHEN inflation IS NULL THEN 0 ELSE .25 END + CASE WHEN fx IS NULL THEN 0 ELSE .20 END + CASE WHEN unemployment IS NULL THEN 0 ELSE .15 END, 0), 3) AS stress FROM g""")
def economic_stress(spark, d):
    """A weighted mean over the components that are present."""
    c = T.load(spark, d, "customer")

    def part(cond):
        return F.avg(F.when(F.expr(cond), F.col("c_acctbal")))

    parts = {"gdp": (0.30, "c_mktsegment = 'AUTOMOBILE'"), "inflation": (0.25, "c_mktsegment = 'BUILDING'"), "fx": (0.20, "c_mktsegment = 'FURNITURE'"), "unemployment": (0.15, "c_mktsegment = 'MACHINERY' and c_custkey % 3 = 0")}
    g = c.groupBy(F.col("c_nationkey").alias("nation")).agg(*[part(cond).alias(k) for k, (_, cond) in parts.items()])
    top = sum((F.coalesce(w * F.col(k), F.lit(0.0)) for k, (w, _) in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNull(), 0.0).otherwise(w) for k, (w, _) in parts.items()), F.lit(0.0))
    return g.select("nation", F.round(F.try_divide(top, weight), 3).alias("stress"))


@query("""
    WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type IN ('click', 'view')) AS verbal, count(*) FILTER (event_type IN ('error', 'purchase')) AS material FROM events GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM d),
    g AS (SELECT user_id, max(n) AS n, avg(material / (verbal + 1)) FILTER (rn <= n // 2) AS early, avg(material / (verbal + 1)) FILTER (rn > n // 2) AS late FROM h GROUP BY 1)
    SELECT user_id, n AS days, CASE WHEN n < 4 THEN 'INSUFFICIENT' WHEN late > early * 1.25 THEN 'ESCALATING' WHEN late < early * 0.75 THEN 'DE_ESCALATING' ELSE 'STABLE' END AS trend FROM g""")
def escalation(spark, d):
    """Material over verbal acts, the second half of the days against the first."""
    e = T.load(spark, d, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("verbal"), F.count_if(F.col("event_type").isin("error", "purchase")).alias("material"))
    w = Window.partitionBy("user_id")
    h = day.withColumns({"rn": F.row_number().over(w.orderBy("day")), "n": F.count("*").over(w), "ratio": F.col("material") / (F.col("verbal") + 1)})
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    g = h.groupBy("user_id").agg(F.max("n").alias("days"), F.avg(F.when(first, F.col("ratio"))).alias("early"), F.avg(F.when(~first, F.col("ratio"))).alias("late"))
    trend = F.when(F.col("days") < 4, "INSUFFICIENT").when(F.col("late") > F.col("early") * 1.25, "ESCALATING").when(F.col("late") < F.col("early") * 0.75, "DE_ESCALATING").otherwise("STABLE")
    return g.select("user_id", "days", trend.alias("trend"))


@query(with_views("positions", """
    SELECT vessel_id, position_id, round(0.9 * pow(0.98, greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0::DOUBLE, 0)), 5) AS confidence,
           CASE WHEN 0.9 * pow(0.98, greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0::DOUBLE, 0)) >= 0.6 THEN 'HIGH' ELSE 'MODERATE' END AS label
    FROM positions WHERE event_type = 'signup'"""))
def decayed_predictions(spark, d):
    p = T.positions(spark, d).where("event_type = 'signup'").withColumn("c", series.decayed(F.lit(0.9), F.col("ts"), T.AS_OF))
    return p.select("vessel_id", "position_id", F.round("c", 5).alias("confidence"), F.when(F.col("c") >= 0.6, "HIGH").otherwise("MODERATE").alias("label"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    return T.load(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 11 ELSE floor(c_acctbal / 1000) + 1 END::BIGINT AS bucket, count(*) AS n FROM customer GROUP BY 1")
def risk_histogram(spark, d):
    return T.load(spark, d, "customer").groupBy(F.width_bucket("c_acctbal", F.lit(0.0), F.lit(10000.0), F.lit(10)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT *, sum(CASE WHEN gap > 3600000000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
               FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events))
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY ALL""")
def sessions(spark, d):
    """Runs of events less than an hour apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros("ts") - F.lag(micros("ts")).over(w)
    s = T.load(spark, d, "events").withColumn("new", F.when(gap.isNull() | (gap > 3_600_000_000), 1).otherwise(0))
    return s.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query(with_views("positions", "SELECT vessel_id, position_id, ts FROM positions QUALIFY row_number() OVER (PARTITION BY vessel_id ORDER BY ts DESC, position_id DESC) = 1"))
def latest_positions(spark, d):
    g = T.positions(spark, d).groupBy("vessel_id").agg(F.max(F.struct("ts", "position_id")).alias("m"))
    return g.select("vessel_id", "m.position_id", "m.ts")


@query(with_views("positions", """
    SELECT position_id, array_to_string(list_filter([CASE WHEN vessel_id % 17 = 0 THEN 'mmsi' END, CASE WHEN lat > 20 THEN 'lat' END, CASE WHEN lon < -75 AND speed_kts > 40 THEN 'speed' END, CASE WHEN nav_status > 6 THEN 'nav_status' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM positions"""))
def position_errors(spark, d):
    """Every broken rule of a position, in a fixed order; rows without any are valid."""
    rules = {"mmsi": F.col("vessel_id") % 17 == 0, "lat": F.col("lat") > 20, "speed": (F.col("lon") < -75) & (F.col("speed_kts") > 40), "nav_status": F.col("nav_status") > 6}
    return T.positions(spark, d).select("position_id", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])), ",").alias("errors"))


@query("""
    WITH RECURSIVE f AS (SELECT 's' || (user_id % 5)::VARCHAR AS source, epoch_us(ts) // 1000000 AS second FROM events WHERE event_type = 'error'),
    p AS (SELECT source, second, count(*) AS n FROM f GROUP BY ALL),
    c AS MATERIALIZED (SELECT a.source, a.second, sum(b.n)::BIGINT AS failures FROM p a JOIN p b ON a.source = b.source AND b.second BETWEEN a.second - 21599 AND a.second GROUP BY ALL HAVING sum(b.n) >= 6),
    r AS (SELECT source, min(second) AS second FROM c GROUP BY 1 UNION ALL SELECT r.source, min(c.second) FROM r JOIN c ON c.source = r.source AND c.second >= r.second + 43200 GROUP BY r.source, r.second)
    SELECT source, second, failures FROM r JOIN c USING (source, second)""")
def failure_alerts(spark, d):
    """Sources with six failures in six hours, told again after twelve hours at the soonest."""
    e = T.load(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.floor(micros("ts") / 1_000_000).alias("second"))
    return alerts.after_silence(alerts.failure_counts(e, 6, 21600), 43200)
