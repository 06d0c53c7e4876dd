"""Weighted scores: vessel risk, shell companies, criminal networks, pressure and crisis."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark import tables as T
from seamark.functions import risk
from seamark.plans.network import typed, typed_contacts
from seamark.plans.registry import query
from seamark.plans.tracks import GAPS, detect_gaps
from seamark.tables import micros, with_views

# Flags of convenience by their number here.
OPEN_FLAGS = (3, 7, 11, 19)


@query(typed(f"""
    WITH {GAPS}, g AS (SELECT vessel_id, count(*) FILTER (epoch_us(ts) >= epoch_us(TIMESTAMP '{T.AS_OF}') - 2592000000000) AS month,
                              count(*) FILTER (epoch_us(ts) >= epoch_us(TIMESTAMP '{T.AS_OF}') - 86400000000) AS day FROM caused GROUP BY 1),
    c AS (SELECT vessel_id, count(*) FILTER (kind = 'ENCOUNTER') AS encounters, count(*) FILTER (kind = 'PORT' AND event_id % 50 = 3) AS ports,
                 count(*) FILTER (kind = 'LOITERING' AND hours >= 40 AND lat < 12 AND lon < -66) AS routes FROM typed GROUP BY 1),
    m AS (SELECT vessel_id, date_trunc('month', seen) AS month FROM typed WHERE kind IN ('ENCOUNTER', 'DARK') GROUP BY ALL HAVING count(DISTINCT kind) = 2),
    e AS (SELECT event_id, count(DISTINCT vessel_id) AS n FROM typed JOIN vessels USING (vessel_id) WHERE kind = 'ENCOUNTER' AND sanctions_status = 'SANCTIONED' GROUP BY 1),
    near AS (SELECT DISTINCT t.vessel_id FROM typed t JOIN e USING (event_id) JOIN vessels v ON v.vessel_id = t.vessel_id WHERE t.kind = 'ENCOUNTER' AND n > (v.sanctions_status = 'SANCTIONED')::INT),
    held AS (SELECT DISTINCT o.dst AS vessel_id FROM ownership o JOIN vessels v ON v.vessel_id = o.src WHERE v.sanctions_status = 'SANCTIONED'),
    known AS (SELECT DISTINCT dst AS vessel_id FROM ownership WHERE pct >= 55)
    SELECT v.vessel_id, least(10.0, round(4.0 * (sanctions_status = 'SANCTIONED')::INT + 3.0 * (held.vessel_id IS NOT NULL)::INT + 2.0 * (coalesce(day, 0) > 0)::INT + 0.2 * least(coalesce(g.month, 0), 5)
           + 2.5 * (coalesce(encounters, 0) > 8)::INT + 3.0 * (v.vessel_id IN (SELECT vessel_id FROM m))::INT + 1.5 * (coalesce(ports, 0) > 0)::INT + 1.0 * (regexp_extract(flag, '[0-9]+')::INT IN (3, 7, 11, 19))::INT
           + 0.5 * least(v.vessel_id % 5, 3) + 1.0 * (known.vessel_id IS NULL)::INT + 2.5 * (coalesce(routes, 0) > 0)::INT + 1.5 * (near.vessel_id IS NOT NULL)::INT, 2))::DOUBLE AS risk
    FROM vessels v LEFT JOIN c USING (vessel_id) LEFT JOIN g USING (vessel_id) LEFT JOIN near USING (vessel_id) LEFT JOIN held USING (vessel_id) LEFT JOIN known USING (vessel_id)""", "positions ownership"))
def vessel_risk(spark, d):
    """The vessel score from all twelve indicators: listing, owners, gaps, transfers, ports, flags, routes and company."""
    v = T.vessels(spark, d)
    ended = micros("ts")
    as_of = F.unix_micros(F.lit(T.AS_OF).cast("timestamp"))
    day = 86_400_000_000
    gaps = detect_gaps(T.positions(spark, d)).groupBy("vessel_id").agg(F.count_if(ended >= as_of - 30 * day).alias("month"), F.count_if(ended >= as_of - day).alias("day"))
    t = typed_contacts(spark, d)
    kind = F.col("kind")
    route = (kind == "LOITERING") & (F.col("hours") >= 40) & (F.col("lat") < 12) & (F.col("lon") < -66)
    # one pass over the contacts, by month first: a dark period and an encounter in one month may be one affair
    by_month = t.groupBy("vessel_id", F.date_trunc("month", "seen").alias("in_month")).agg(
        F.count_if(kind == "ENCOUNTER").alias("met"), F.count_if(kind == "DARK").alias("dark"), F.count_if((kind == "PORT") & (F.col("event_id") % 50 == 3)).alias("ports"), F.count_if(route).alias("routes")
    )
    counts = by_month.groupBy("vessel_id").agg(F.sum("met").alias("encounters"), F.sum("ports").alias("ports"), F.sum("routes").alias("routes"), F.bool_or((F.col("met") > 0) & (F.col("dark") > 0)).alias("dark_transfer"))
    listed = v.where("sanctions_status = 'SANCTIONED'").select("vessel_id")
    met = t.where("kind = 'ENCOUNTER'").select("vessel_id", "event_id").distinct()
    with_listed = met.join(listed, "vessel_id").groupBy("event_id").agg(F.count("*").alias("n"))
    near = met.join(with_listed, "event_id").groupBy("vessel_id").agg(F.max("n").alias("company"))
    o = T.ownership(spark, d)
    owners = o.join(listed.withColumnRenamed("vessel_id", "src"), "src", "left_semi").select(F.col("dst").alias("vessel_id"), F.lit(True).alias("owner_listed")).distinct()
    known = o.where("pct >= 55").select(F.col("dst").alias("vessel_id"), F.lit(True).alias("owner_known")).distinct()
    for part in (counts, gaps, near, owners, known):
        v = v.join(part, "vessel_id", "left")
    listing = F.col("sanctions_status") == "SANCTIONED"
    score = risk.vessel_risk({
        "sanctioned": listing,
        "owner_sanctioned": F.col("owner_listed"),
        "gap_last_day": F.col("day") > 0,
        "gaps_last_month": F.col("month"),
        "transfer": F.col("encounters") > 8,
        "dark_transfer": F.col("dark_transfer"),
        "risky_port": F.col("ports") > 0,
        "risky_flag": F.regexp_extract("flag", "[0-9]+", 0).cast("int").isin(*OPEN_FLAGS),
        "flag_changes": F.col("vessel_id") % 5,
        "owner_unknown": F.col("owner_known").isNull(),
        "cartel_route": F.col("routes") > 0,
        "near_sanctioned": F.col("company") > F.when(listing, 1).otherwise(0),
    })
    return v.select("vessel_id", score.alias("risk"))


COMPANY = """company AS (SELECT s_suppkey AS company_id, 'Company ' || s_suppkey::VARCHAR AS name, s_nationkey AS jurisdiction, s_suppkey * 7 % 40 AS address_id, s_suppkey % 12 AS agent_id,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 9 END AS employees, s_acctbal < 0 AS overdue, s_suppkey * 13 % 900 AS age_days FROM supplier)"""


def companies(spark, d):
    k = F.col("s_suppkey")
    return T.load(spark, d, "supplier").select(
        k.alias("company_id"), F.concat(F.lit("Company "), k.cast("string")).alias("name"), F.col("s_nationkey").alias("jurisdiction"), (k * 7 % 40).alias("address_id"), (k % 12).alias("agent_id"),
        F.when(k % 6 != 0, k % 9).alias("employees"), (F.col("s_acctbal") < 0).alias("overdue"), (k * 13 % 900).alias("age_days"),
    )


@query(f"""
    WITH {COMPANY}, a AS (SELECT address_id, count(*) - 1 AS others FROM company GROUP BY 1),
    o AS (SELECT dst AS company_id, max(pct) AS pct FROM own GROUP BY 1),
    x AS (SELECT l_suppkey AS company_id, count(DISTINCT l_partkey) AS kinds FROM lineitem WHERE l_quantity >= 45 GROUP BY 1),
    s AS (SELECT c.company_id, 2.0 * (jurisdiction IN (3, 7, 11))::INT + 2.0 * (agent_id IN (2, 5))::INT + 2.0 * (coalesce(pct, 0) < 60)::INT + CASE WHEN employees IS NULL THEN 0.5 WHEN employees = 0 THEN 1.0 ELSE 0.0 END
                 + 1.0 * (company_id % 14 = 3)::INT + 1.0 * (others > 10)::INT + 1.0 * (age_days <= 365)::INT + 1.0 * (coalesce(kinds, 0) = 0)::INT + 1.0 * overdue::INT + 0.5 * regexp_matches(name, '^Company [0-9]$')::INT
                 + 0.5 * (company_id % 12 = company_id % 16)::INT + 0.5 * (address_id % 8 = 0)::INT AS score
          FROM company c JOIN a USING (address_id) LEFT JOIN o USING (company_id) LEFT JOIN x USING (company_id))
    SELECT company_id, round(score, 2)::DOUBLE AS score, CASE WHEN score >= 5 THEN 'SHELL' WHEN score >= 3 THEN 'POSSIBLE' ELSE 'NORMAL' END AS class FROM s""".replace("FROM own ", "FROM (SELECT c_custkey AS dst, 51.0 + c_custkey % 49 AS pct FROM customer WHERE c_custkey > 0 UNION ALL SELECT (c_custkey * 7 + 3) % 97, 10.0 + c_custkey % 40 FROM customer WHERE c_custkey % 29 = 0 AND c_custkey < 290) "))
def shell_score(spark, d):
    """All twelve indicators of a shell company; an unknown headcount counts half."""
    c = companies(spark, d)
    others = c.groupBy("address_id").agg((F.count("*") - 1).alias("others"))
    owner = T.ownership(spark, d).groupBy(F.col("dst").alias("company_id")).agg(F.max("pct").alias("pct"))
    active = T.load(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_suppkey").alias("company_id")).agg(F.count("*").alias("kinds"))
    s = c.join(others, "address_id").join(owner, "company_id", "left").join(active, "company_id", "left")
    k = F.col("company_id")
    points = risk.shell_points(
        {
            "opaque_jurisdiction": F.col("jurisdiction").isin(3, 7, 11),
            "formation_agent": F.col("agent_id").isin(2, 5),
            "no_owner": F.coalesce("pct", F.lit(0.0)) < 60,
            "nominee": k % 14 == 3,
            "shared_address": F.col("others") > 10,
            "young": F.col("age_days") <= 365,
            "no_activity": F.col("kinds").isNull(),
            "overdue": F.col("overdue"),
            "generic_name": F.col("name").rlike("^Company [0-9]$"),
            "agent_directs": k % 12 == k % 16,
            "po_box": F.col("address_id") % 8 == 0,
        },
        F.col("employees"),
    )
    s = s.withColumn("score", points)
    return s.select("company_id", "score", F.when(F.col("score") >= 5, "SHELL").when(F.col("score") >= 3, "POSSIBLE").otherwise("NORMAL").alias("class"))


@query(f"""
    WITH {COMPANY} SELECT a.company_id AS a, b.company_id AS b, a.address_id FROM company a JOIN company b ON a.address_id = b.address_id AND a.company_id < b.company_id AND a.jurisdiction <> b.jurisdiction""")
def shared_addresses(spark, d):
    c = companies(spark, d).select("company_id", "address_id", "jurisdiction")
    b = c.select(F.col("company_id").alias("b"), "address_id", F.col("jurisdiction").alias("j"))
    return c.withColumnRenamed("company_id", "a").join(b, "address_id").where("a < b and jurisdiction <> j").select("a", "b", "address_id")


@query(with_views("ownership", f"""
    WITH {COMPANY}, ship AS (SELECT l_suppkey AS company_id, max(l_quantity)::DOUBLE AS longest, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS routes FROM lineitem GROUP BY 1),
    agent AS (SELECT agent_id, count(*) - 1 AS others FROM company GROUP BY 1), near AS (SELECT dst AS company_id, min(src % 10) AS hop FROM ownership GROUP BY 1),
    s AS (SELECT c.company_id, CASE WHEN coalesce(hop, 9) <= 1 THEN 30 WHEN coalesce(hop, 9) <= 3 THEN 15 ELSE 0 END AS proximity, CASE WHEN longest >= 50 THEN 25 WHEN longest >= 48 THEN 18 WHEN longest >= 24 THEN 10 ELSE 0 END AS gaps,
                 least(20, 5 * others) AS agents, CASE WHEN c.age_days < 90 THEN 25 ELSE 0 END AS young, least(20, 4 * coalesce(routes, 0)) AS events FROM company c LEFT JOIN ship USING (company_id) LEFT JOIN agent USING (agent_id) LEFT JOIN near USING (company_id))
    SELECT company_id, (proximity + gaps + agents + young + events)::BIGINT AS score, CASE WHEN proximity + gaps + agents + young + events >= 100 THEN 'CRITICAL' WHEN proximity + gaps + agents + young + events >= 70 THEN 'HIGH'
           WHEN proximity + gaps + agents + young + events >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s"""))
def network_score(spark, d):
    """Rules with caps, each from a table of its own, joined by company."""
    li = T.load(spark, d, "lineitem")
    c = companies(spark, d)
    ship = li.groupBy(F.col("l_suppkey").alias("company_id")).agg(F.max("l_quantity").alias("longest"), F.countDistinct(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), F.col("l_partkey"))).alias("routes"))
    agent = c.groupBy("agent_id").agg((F.count("*") - 1).alias("others"))
    near = T.ownership(spark, d).groupBy(F.col("dst").alias("company_id")).agg(F.min(F.col("src") % 10).alias("hop"))
    s = c.join(ship, "company_id", "left").join(agent, "agent_id", "left").join(near, "company_id", "left")
    hop, longest = F.coalesce("hop", F.lit(9)), F.col("longest")
    score = (
        F.when(hop <= 1, 30).when(hop <= 3, 15).otherwise(0)
        + F.when(longest >= 50, 25).when(longest >= 48, 18).when(longest >= 24, 10).otherwise(0)
        + F.least(F.lit(20), 5 * F.col("others"))
        + F.when(F.col("age_days") < 90, 25).otherwise(0)
        + F.least(F.lit(20), 4 * F.coalesce("routes", F.lit(0)))
    ).cast("long")
    return s.select("company_id", score.alias("score"), F.when(score >= 100, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW").alias("level"))


@query(with_views("causes", """
    WITH g AS (SELECT dst AS ticker, sum(coalesce(confidence, 1) * (src % 4 + 1) / greatest(1, src % 6)) AS pressure, count(*) AS causes FROM causes WHERE dst % 9 <> 4 OR dst IS NULL GROUP BY 1)
    SELECT ticker, causes, round(pressure, 4) AS pressure, CASE WHEN pressure / (8 + ticker % 3) >= 2 THEN 'CRITICAL' WHEN pressure / (8 + ticker % 3) >= 1.5 THEN 'HIGH' WHEN pressure / (8 + ticker % 3) >= 1 THEN 'ELEVATED' WHEN pressure / (8 + ticker % 3) >= 0.7 THEN 'WATCH' ELSE 'NORMAL' END AS level FROM g"""))
def early_warning(spark, d):
    """Weight times confidence times severity over lag, summed, against each instrument's threshold."""
    c = T.causes(spark, d).where("dst % 9 <> 4 or dst is null")
    g = c.groupBy(F.col("dst").alias("ticker")).agg(F.sum(F.coalesce("confidence", F.lit(1.0)) * (F.col("src") % 4 + 1) / F.greatest(F.lit(1), F.col("src") % 6)).alias("p"), F.count("*").alias("causes"))
    ratio = F.col("p") / (8 + F.col("ticker") % 3)
    return g.select("ticker", "causes", F.round("p", 4).alias("pressure"), F.when(ratio >= 2, "CRITICAL").when(ratio >= 1.5, "HIGH").when(ratio >= 1, "ELEVATED").when(ratio >= 0.7, "WATCH").otherwise("NORMAL").alias("level"))


@query("""
    WITH i AS (SELECT c_nationkey AS country, c_mktsegment AS indicator, count(*) AS n, avg(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 10 / 10.0::DOUBLE END) AS conf, avg(c_custkey % 11)::DOUBLE AS risk, max(c_custkey % 6) AS phase, sum(abs(c_acctbal)) AS pop FROM customer GROUP BY ALL),
    s AS (SELECT country, CASE indicator WHEN 'AUTOMOBILE' THEN .25 WHEN 'BUILDING' THEN .20 WHEN 'FURNITURE' THEN .15 WHEN 'HOUSEHOLD' THEN .12 ELSE .10 END *
          least(1.0, .25 * least(1.0, n / 10.0) + .25 * coalesce(conf, .5) + .25 * least(1.0, coalesce(risk, 5) / 10.0) + .3 * least(1.0, phase / 5.0) + .25 * least(1.0, log10(greatest(pop, 1)) / 7)) AS part FROM i)
    SELECT country, round(sum(part), 5) AS score, CASE WHEN sum(part) >= .85 THEN 'IMMINENT' WHEN sum(part) >= .65 THEN 'HIGH' WHEN sum(part) >= .45 THEN 'ELEVATED' WHEN sum(part) >= .25 THEN 'WATCH' ELSE 'LOW' END AS level FROM s GROUP BY 1""")
def crisis_score(spark, d):
    """Per country the weighted signals of its indicators."""
    k = F.col("c_custkey")
    i = T.load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("indicator")).agg(
        F.count("*").alias("n"), F.avg(F.when(k % 7 != 0, k % 10 / 10.0)).alias("conf"), F.avg(k % 11).alias("risk"), F.max(k % 6).alias("phase"), F.sum(F.abs("c_acctbal")).alias("pop")
    )
    one = F.lit(1.0)
    signal = (
        0.25 * F.least(one, F.col("n") / 10.0) + 0.25 * F.coalesce("conf", F.lit(0.5)) + 0.25 * F.least(one, F.coalesce("risk", F.lit(5.0)) / 10.0)
        + 0.3 * F.least(one, F.col("phase") / 5.0) + 0.25 * F.least(one, F.log10(F.greatest("pop", F.lit(1.0))) / 7)
    )
    weight = F.when(F.col("indicator") == "AUTOMOBILE", 0.25).when(F.col("indicator") == "BUILDING", 0.20).when(F.col("indicator") == "FURNITURE", 0.15).when(F.col("indicator") == "HOUSEHOLD", 0.12).otherwise(0.10)
    g = i.groupBy("country").agg(F.sum(weight * F.least(one, signal)).alias("s"))
    return g.select("country", F.round("s", 5).alias("score"), F.when(F.col("s") >= 0.85, "IMMINENT").when(F.col("s") >= 0.65, "HIGH").when(F.col("s") >= 0.45, "ELEVATED").when(F.col("s") >= 0.25, "WATCH").otherwise("LOW").alias("level"))


@query("""
    SELECT c_nationkey AS country, count(*) AS n, round(avg(c_acctbal), 4) AS tone, round(sum(o_totalprice), 2) AS mentions FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
    GROUP BY 1 ORDER BY n DESC, country LIMIT 15""")
def volume_by_country(spark, d):
    o = T.load(spark, d, "orders").where("o_orderdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1999-12-31'")
    c = T.load(spark, d, "customer")
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("tone"), F.round(F.sum("o_totalprice"), 2).alias("mentions"))
    return g.orderBy(F.desc("n"), "country").limit(15)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (value > 100) AS large, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def ingestion_health(spark, d):
    return T.load(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("value") > 100).alias("large"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95")
    )
