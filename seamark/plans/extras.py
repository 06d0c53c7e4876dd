"""Extraction, validation and further scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamark import tables as T
from seamark.functions import connectives
from seamark.operators.paths import reach
from seamark.plans.network import typed, typed_contacts
from seamark.plans.registry import query
from seamark.tables import with_views


def _markers() -> str:
    backward = set(connectives.BACKWARD)
    rows = [(p, t, connectives.TIERS[t], p in backward) for lists in (connectives.ENGLISH, connectives.SPANISH) for t, ps in lists.items() for p in ps]
    return "markers(marker, tier, confidence, backward) AS (VALUES " + ", ".join(f"('{m}', '{t}', {c}::DOUBLE, {b})" for m, t, c, b in rows) + ")"


REPORTS = """reports AS (SELECT p_partkey, 'The ' || p_name || ' shortage ' || CASE p_partkey % 6 WHEN 0 THEN 'was caused by' WHEN 1 THEN 'led to' WHEN 2 THEN 'has not triggered' WHEN 3 THEN 'and the delay, due to' WHEN 4 THEN 'fue provocado por' ELSE 'came with' END
    || ' a ' || p_type || ' strike. Prices rose after the closure of port ' || p_size::VARCHAR || '.' AS body FROM part)"""


def reports(spark, d):
    """Short reports made of part names, sizes and connectives."""
    k = F.col("p_partkey") % 6
    link = F.when(k == 0, "was caused by").when(k == 1, "led to").when(k == 2, "has not triggered").when(k == 3, "and the delay, due to").when(k == 4, "fue provocado por").otherwise("came with")
    body = F.concat(F.lit("The "), "p_name", F.lit(" shortage "), link, F.lit(" a "), "p_type", F.lit(" strike. Prices rose after the closure of port "), F.col("p_size").cast("string"), F.lit("."))
    return T.load(spark, d, "part").select("p_partkey", body.alias("body"))


@query(f"""
    WITH {REPORTS}, {_markers()},
    s AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(unnest(regexp_split_to_array(body, '[.!?\\n]+'))), '[\\s,;:()"]+', ' ', 'g')) || ' ' AS s FROM reports),
    m AS (SELECT *, trim(substr(s, 1, strpos(s, ' ' || marker || ' '))) AS l, trim(substr(s, strpos(s, ' ' || marker || ' ') + length(marker) + 1)) AS r FROM s JOIN markers ON contains(s, ' ' || marker || ' ')),
    c AS (SELECT *, CASE WHEN backward THEN r ELSE l END AS cause, CASE WHEN backward THEN l ELSE r END AS effect FROM m)
    SELECT p_partkey, cause, effect, marker, tier, confidence, len(list_intersect(string_split(l, ' ')[-4:], string_split('{'|'.join(connectives.NEGATIONS)}', '|'))) > 0 AS negated
    FROM c WHERE len(string_split(cause, ' ')) >= 2 AND len(string_split(effect, ' ')) >= 2""")
def connective_triplets(spark, d):
    return connectives.triplets(reports(spark, d), "p_partkey", "body")


# Vessel types and drugs of the entity dictionaries.
VESSEL_TERMS = "go-fast boat|go fast boat|panga|semi-submersible|narco submarine|narco-submarine|fishing vessel|bulk carrier|container ship|tanker|cargo vessel|speedboat|motor vessel|sailing vessel"
DRUG_TERMS = "cocaine|heroin|fentanyl|methamphetamine|meth|marijuana|cannabis|MDMA|ecstasy|ketamine|oxycodone|opioid|precursor chemicals|coca paste|crack cocaine|crystal meth|synthetic opioid"
SIGHTINGS = """sightings AS (SELECT o_orderkey, 'A ' || CASE o_orderkey % 4 WHEN 0 THEN 'Fishing Vessel' WHEN 1 THEN 'panga' WHEN 2 THEN 'tanker' ELSE 'yacht' END || ' IMO ' || lpad((o_custkey + 9000000)::VARCHAR, 7, '0') || ' carried ' || (o_orderkey % 9000)::VARCHAR
    || ' kg of ' || CASE o_orderkey % 3 WHEN 0 THEN 'cocaine' WHEN 1 THEN 'Fentanyl' ELSE 'coffee' END || ' worth $' || (o_orderkey % 90 + 1)::VARCHAR || ' million' AS note FROM orders)"""


@query(f"""
    WITH {SIGHTINGS}
    SELECT o_orderkey, regexp_extract(note, '(?i)\\bIMO\\s*([0-9]{{7}})\\b', 1) AS imo, lower(regexp_extract(note, '(?i)\\b({VESSEL_TERMS})\\b', 1)) AS vessel_type, lower(regexp_extract(note, '(?i)\\b({DRUG_TERMS})\\b', 1)) AS drug,
           coalesce(try_cast(replace(regexp_extract(note, '([0-9][0-9,.]+)\\s*kg\\b', 1), ',', '') AS DOUBLE), -1) AS kilos,
           coalesce(try_cast(regexp_extract(note, '\\$\\s*([0-9,.]+)\\s*(million)?', 1) AS DOUBLE), 0) * CASE WHEN regexp_extract(note, '\\$\\s*([0-9,.]+)\\s*(million)?', 2) = 'million' THEN 1000000 ELSE 1 END AS dollars FROM sightings""")
def dictionary_entities(spark, d):
    """Identifiers, dictionary terms, quantities and money in notes."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "Fishing Vessel").when(k % 4 == 1, "panga").when(k % 4 == 2, "tanker").otherwise("yacht")
    cargo = F.when(k % 3 == 0, "cocaine").when(k % 3 == 1, "Fentanyl").otherwise("coffee")
    note = F.concat(F.lit("A "), kind, F.lit(" IMO "), F.lpad((F.col("o_custkey") + 9000000).cast("string"), 7, "0"), F.lit(" carried "), (k % 9000).cast("string"), F.lit(" kg of "), cargo, F.lit(" worth $"), (k % 90 + 1).cast("string"), F.lit(" million"))
    n = T.load(spark, d, "orders").select("o_orderkey", note.alias("note"))
    money = r"\$\s*([0-9,.]+)\s*(million)?"
    return n.select(
        "o_orderkey",
        F.regexp_extract("note", r"(?i)\bIMO\s*([0-9]{7})\b", 1).alias("imo"),
        F.lower(F.regexp_extract("note", rf"(?i)\b({VESSEL_TERMS})\b", 1)).alias("vessel_type"),
        F.lower(F.regexp_extract("note", rf"(?i)\b({DRUG_TERMS})\b", 1)).alias("drug"),
        F.coalesce(F.replace(F.regexp_extract("note", r"([0-9][0-9,.]+)\s*kg\b", 1), F.lit(","), F.lit("")).try_cast("double"), F.lit(-1.0)).alias("kilos"),
        (F.coalesce(F.regexp_extract("note", money, 1).try_cast("double"), F.lit(0.0)) * F.when(F.regexp_extract("note", money, 2) == "million", 1000000).otherwise(1)).alias("dollars"),
    )


@query("""
    WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D.,]+')) AS token FROM conversations)
    SELECT token, count(DISTINCT conv_id) AS conversations, count(*) AS n FROM w GROUP BY 1 HAVING count(DISTINCT conv_id) >= 5""")
def token_index(spark, d):
    """Document frequencies of a search index: distinct per conversation before the shuffle by token."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D.,]+"), 0)).alias("token")
    per = T.load(spark, d, "conversations").select("conv_id", token).groupBy("conv_id", "token").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("conversations"), F.sum("n").alias("n")).where("conversations >= 5")


@query("""
    WITH e AS (SELECT event_id, 'prediction' AS schema, CASE event_id % 7 WHEN 0 THEN '2.0' WHEN 1 THEN '1.7' ELSE '1.0' END AS version, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'p' || event_id::VARCHAR END AS id FROM events)
    SELECT event_id, CASE WHEN split_part(version, '.', 1) <> '1' THEN 'version' WHEN id IS NULL THEN 'id' ELSE 'ok' END AS verdict FROM e""")
def envelope_verdicts(spark, d):
    """A minor version may be newer; a major one may not. An id must be there."""
    k = F.col("event_id")
    e = T.load(spark, d, "events").select("event_id", F.when(k % 7 == 0, "2.0").when(k % 7 == 1, "1.7").otherwise("1.0").alias("version"), F.when(k % 11 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("id"))
    return e.select("event_id", F.when(F.split("version", r"\.")[0] != "1", "version").when(F.col("id").isNull(), "id").otherwise("ok").alias("verdict"))


@query("""
    WITH c AS (SELECT c_custkey, (c_custkey * 7 % 150) AS deaths, (c_custkey % 6) AS phase, c_custkey * 37 % 5000 AS displaced FROM customer)
    SELECT c_custkey, CASE WHEN deaths >= 100 THEN 0.95 WHEN deaths >= 10 THEN 0.7 WHEN deaths >= 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS weight, CASE WHEN deaths >= 100 THEN 9.0 WHEN deaths >= 10 THEN 7.0 WHEN deaths >= 1 THEN 5.0 ELSE 3.0 END::DOUBLE AS risk,
           substr(sha256('conflict|' || c_custkey::VARCHAR), 1, 24) AS event_id FROM c WHERE phase >= 3 OR displaced >= 1000""")
def humanitarian_rows(spark, d):
    """Severity bands of conflict rows; only crises and large displacements stay."""
    from seamark.functions.text import short_id

    k = F.col("c_custkey")
    c = T.load(spark, d, "customer").where((k % 6 >= 3) | (k * 37 % 5000 >= 1000))
    deaths = k * 7 % 150
    return c.select(
        "c_custkey", F.when(deaths >= 100, 0.95).when(deaths >= 10, 0.7).when(deaths >= 1, 0.5).otherwise(0.3).alias("weight"), F.when(deaths >= 100, 9.0).when(deaths >= 10, 7.0).when(deaths >= 1, 5.0).otherwise(3.0).alias("risk"),
        short_id(F.lit("conflict"), k.cast("string")).alias("event_id"),
    )


@query(typed("""
    WITH k AS (SELECT vessel_id, kind, count(*) AS n FROM typed GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY n DESC, kind) AS place FROM k)
    SELECT vessel_id, array_to_string(list(kind ORDER BY place), '>') AS actions FROM r WHERE place <= 3 GROUP BY 1"""))
def top_actions(spark, d):
    """The three most frequent kinds of event of a vessel, ties by name."""
    k = typed_contacts(spark, d).groupBy("vessel_id", "kind").agg(F.count("*").alias("n"))
    r = k.withColumn("place", F.row_number().over(Window.partitionBy("vessel_id").orderBy(F.desc("n"), "kind"))).where("place <= 3")
    return r.groupBy("vessel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), ">").alias("actions"))


@query(with_views("causes", """
    WITH e AS (SELECT src AS a, dst AS b, edge_id, confidence FROM causes UNION ALL SELECT dst, src, edge_id, confidence FROM causes)
    SELECT a % 9 AS type_a, b % 9 AS type_b, count(*) AS n, round(avg(confidence), 4) AS confidence FROM e GROUP BY ALL HAVING count(*) > 2"""))
def correlation_summary(spark, d):
    """Links by the types at their ends, in both directions."""
    c = T.causes(spark, d)
    both = c.select(F.col("src").alias("a"), F.col("dst").alias("b"), "confidence").unionByName(c.select(F.col("dst").alias("a"), F.col("src").alias("b"), "confidence"))
    return both.groupBy((F.col("a") % 9).alias("type_a"), (F.col("b") % 9).alias("type_b")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence")).where("n > 2")


@query(with_views("causes", """
    WITH e AS (SELECT DISTINCT src AS a, dst AS b FROM causes UNION SELECT dst, src FROM causes), r AS (SELECT 7::BIGINT AS node, 0 AS hops UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 3)
    SELECT node, min(hops) AS hops FROM r GROUP BY 1""", recursive=True))
def seed_neighbourhood(spark, d, seed=7):
    """Everything within three links of a seed, itself included."""
    c = T.causes(spark, d)
    return reach(c, c.where(F.col("src") == seed).select(F.col("src").alias("root")).distinct(), 3, undirected=True).select("node", "hops")


@query("""
    WITH n AS (SELECT c_custkey % 40 AS nominee, c_nationkey AS jurisdiction, c_custkey AS company FROM customer WHERE c_acctbal < 5000)
    SELECT nominee, count(DISTINCT jurisdiction) AS jurisdictions, count(DISTINCT company) AS companies, round(least(25.0, 15 + (count(DISTINCT jurisdiction) - 3) * 2.5), 2) AS score FROM n GROUP BY 1 HAVING count(DISTINCT jurisdiction) >= 3""")
def nominee_networks(spark, d):
    """Nominees with companies in three jurisdictions or more."""
    n = T.load(spark, d, "customer").where("c_acctbal < 5000").groupBy((F.col("c_custkey") % 40).alias("nominee")).agg(F.countDistinct("c_nationkey").alias("jurisdictions"), F.countDistinct("c_custkey").alias("companies"))
    return n.where("jurisdictions >= 3").withColumn("score", F.round(F.least(F.lit(25.0), 15 + (F.col("jurisdictions") - 3) * 2.5), 2))


@query("""
    WITH g AS (SELECT s_nationkey AS jurisdiction, (s_suppkey * 13 % 900) // 30 AS month, count(*) AS n FROM supplier GROUP BY ALL)
    SELECT jurisdiction, max(n) AS most, round(CASE WHEN max(n) > 1 THEN 10 + (max(n) - 1) * 0.33 ELSE 0 END, 4) AS score FROM g GROUP BY 1""")
def mass_incorporation(spark, d):
    g = T.load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("jurisdiction"), F.floor((F.col("s_suppkey") * 13 % 900) / 30).alias("month")).agg(F.count("*").alias("n"))
    return g.groupBy("jurisdiction").agg(F.max("n").alias("most")).withColumn("score", F.round(F.when(F.col("most") > 1, 10 + (F.col("most") - 1) * 0.33).otherwise(0.0), 4))


@query(r"""
    WITH f AS (SELECT p_partkey, 'Schedule 13' || CASE p_partkey % 2 WHEN 0 THEN 'D' ELSE 'G' END || ' name of reporting person: ' || p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'percent of class ' || (p_partkey % 130)::VARCHAR || '.5%' WHEN 1 THEN 'owns ' || (p_partkey % 99)::VARCHAR || ' % of shares' ELSE 'n/a' END AS t FROM part),
    x AS (SELECT p_partkey, try_cast(regexp_extract(t, 'percent of class ([0-9.]+)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(t, 'owns ([0-9.]+) ?%', 1) AS DOUBLE) AS b FROM f)
    SELECT p_partkey, coalesce(CASE WHEN a > 0 AND a <= 100 THEN a END, CASE WHEN b > 0 AND b <= 100 THEN b END, -1) AS pct FROM x""")
def filing_percents(spark, d):
    """The first pattern that gives a share above 0 and up to 100."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit("percent of class "), (k % 130).cast("string"), F.lit(".5%"))).when(k % 3 == 1, F.concat(F.lit("owns "), (k % 99).cast("string"), F.lit(" % of shares"))).otherwise("n/a")
    t = F.concat(F.lit("Schedule 13"), F.when(k % 2 == 0, "D").otherwise("G"), F.lit(" name of reporting person: "), "p_name", F.lit(" "), tail)
    f = T.load(spark, d, "part").select("p_partkey", t.alias("t"))
    found = [F.regexp_extract("t", p, 1).try_cast("double") for p in ("percent of class ([0-9.]+)", "owns ([0-9.]+) ?%")]
    return f.select("p_partkey", F.coalesce(*[F.when((x > 0) & (x <= 100), x) for x in found], F.lit(-1.0)).alias("pct"))


@query(with_views("positions", """
    SELECT prediction_id, trigger_id, confidence FROM (
        SELECT p.position_id AS prediction_id, coalesce(t.position_id, -1) AS trigger_id, round(p.value / 500, 5) AS confidence, row_number() OVER (ORDER BY p.value DESC, p.position_id) AS rn FROM positions p
        LEFT JOIN positions t ON t.position_id = p.position_id - 3 AND t.event_type = 'error' WHERE p.event_type = 'purchase' AND p.value >= 60) WHERE rn <= 100"""))
def prediction_search(spark, d, minimum=60, limit=100):
    """Predictions by confidence with their optional trigger; the limit is the caller's, 1 to 1000."""
    p = T.positions(spark, d)
    t = p.where("event_type = 'error'").select(F.col("position_id").alias("trigger"))
    top = p.where((F.col("event_type") == "purchase") & (F.col("value") >= minimum)).orderBy(F.desc("value"), "position_id").limit(max(1, min(1000, limit)))
    return top.join(t, F.col("trigger") == F.col("position_id") - 3, "left").select(F.col("position_id").alias("prediction_id"), F.coalesce("trigger", F.lit(-1)).alias("trigger_id"), F.round(F.col("value") / 500, 5).alias("confidence"))


@query("""
    WITH g AS (SELECT (event_id % 60) AS y, (event_id * 7 % 61) AS x, avg(value) AS v FROM events GROUP BY ALL),
    n AS (SELECT a.y, a.x, any_value(a.v) AS v, avg(b.v) AS background, count(*) AS cells FROM g a JOIN g b ON abs(a.y - b.y) <= 6 AND abs(a.x - b.x) <= 6 AND greatest(abs(a.y - b.y), abs(a.x - b.x)) > 2 GROUP BY a.y, a.x)
    SELECT y, x, round(v + 1e-9, 6) AS v, round(background + 1e-9, 6) AS background FROM n WHERE 10 * log10(greatest(v, 1e-10)) >= 10 * log10(greatest(background, 1e-10)) + 3 AND cells >= 20""")
def bright_cells(spark, d):
    """Constant-false-alarm detection on a grid: a cell against the mean of the ring around it, guard cells left out."""
    e = F.col("event_id")
    g = T.load(spark, d, "events").groupBy((e % 60).alias("y"), (e * 7 % 61).alias("x")).agg(F.avg("value").alias("v"))
    ring = [(dy, dx) for dy in range(-6, 7) for dx in range(-6, 7) if max(abs(dy), abs(dx)) > 2]
    spread = g.select(F.col("v").alias("bv"), F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ring])).alias("to")).select("bv", "to.y", "to.x")
    around = spread.groupBy("y", "x").agg(F.avg("bv").alias("background"), F.count("*").alias("cells")).where("cells >= 20")
    db = [10 * F.log10(F.greatest(F.col(c), F.lit(1e-10))) for c in ("v", "background")]
    return g.join(around, ["y", "x"]).where(db[0] >= db[1] + 3).select("y", "x", F.round(F.col("v") + 1e-9, 6).alias("v"), F.round(F.col("background") + 1e-9, 6).alias("background"))
