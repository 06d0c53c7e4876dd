"""Cascades between domains, money trails and neighbourhoods, on graphs that grow with the parts and customers.

A part is an incident: its type is the kind, its size the domain. Incident k
is caused by k/2 and k/3. Prefixes of other edge types go before the causal
hops, and their confidence counts too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark import tables as T
from seamark.operators.graph import written
from seamark.operators.joins import SHUFFLED
from seamark.operators.paths import expand_paths, reach
from seamark.plans.registry import query
from seamark.tables import with_views

INCIDENTS = """incidents AS (SELECT p_partkey AS event_id, p_name AS description,
    CASE p_type WHEN 'ECONOMY' THEN 'CANAL_DISRUPTION' WHEN 'LARGE' THEN 'FAMINE' WHEN 'MEDIUM' THEN 'DISPLACEMENT' WHEN 'PROMO' THEN 'SANCTIONS_DESIGNATION' WHEN 'SMALL' THEN 'PRICE_ANOMALY' ELSE 'CARTEL_INTERDICTION' END AS event_type,
    CASE WHEN p_size <= 10 THEN 'maritime' WHEN p_size <= 20 THEN 'security' WHEN p_size <= 30 THEN 'humanitarian' WHEN p_size <= 40 THEN 'financial' ELSE 'social_media' END AS domain FROM part),
    leads AS (SELECT 'h' || p_partkey::VARCHAR AS edge_id, p_partkey // 2 AS src, p_partkey AS dst, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 7 + 3) / 10.0::DOUBLE ELSE 0.5 END AS c FROM part WHERE p_partkey > 0
              UNION ALL SELECT 't' || p_partkey::VARCHAR, p_partkey // 3, p_partkey, (p_partkey % 5 + 4) / 10.0::DOUBLE FROM part WHERE p_partkey > 0),
    affects AS (SELECT 'm' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS edge_id, l_partkey AS event_id, l_suppkey AS instrument, least(1.0, max(l_quantity)::DOUBLE / 50) AS c FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def incidents(spark, d) -> DataFrame:
    """Causal events: ``event_id``, ``description``, ``event_type``, ``domain``."""
    kinds = {"ECONOMY": "CANAL_DISRUPTION", "LARGE": "FAMINE", "MEDIUM": "DISPLACEMENT", "PROMO": "SANCTIONS_DESIGNATION", "SMALL": "PRICE_ANOMALY"}
    kind = F.lit("CARTEL_INTERDICTION")
    for part_type, name in kinds.items():
        kind = F.when(F.col("p_type") == part_type, name).otherwise(kind)
    size = F.col("p_size")
    domain = F.when(size <= 10, "maritime").when(size <= 20, "security").when(size <= 30, "humanitarian").when(size <= 40, "financial").otherwise("social_media")
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("description"), kind.alias("event_type"), domain.alias("domain"))


def leads(spark, d) -> DataFrame:
    """Causal edges: ``edge_id``, ``src``, ``dst``, ``confidence``; an unknown confidence counts half."""
    k = F.col("p_partkey")
    p = T.load(spark, d, "part").where("p_partkey > 0")

    def edge(kind: str, by: int, confidence: Column) -> DataFrame:
        return p.select(F.concat(F.lit(kind), k.cast("string")).alias("edge_id"), F.floor(k / by).cast("long").alias("src"), k.alias("dst"), confidence.alias("confidence"))

    known = F.when(k % 11 != 0, (k % 7 + 3) / 10.0).otherwise(0.5)
    return edge("h", 2, known).unionByName(edge("t", 3, (k % 5 + 4) / 10.0))


def affects(spark, d) -> DataFrame:
    """Edges from incidents to the instruments (suppliers) they move."""
    g = T.load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.least(F.lit(1.0), F.max("l_quantity").cast("double") / 50).alias("c"))
    name = F.concat(F.lit("m"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return g.select(name.alias("edge_id"), F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("instrument"), "c")


def strongest(paths: DataFrame, n: int) -> DataFrame:
    """The ``n`` paths of highest score; ties by their edges."""
    out = paths.select("root", "node", "hops", F.array_join("edge_ids", ">").alias("path"), F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "path").limit(n)


def ending(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """``paths`` that end at an incident of ``ends``; the keys of a large table are never broadcast."""
    return paths.join(ends.select(F.col("event_id").alias("node")).hint(SHUFFLED), "node", "left_semi")


def strongest_ways(edges: DataFrame, start: DataFrame, ends: DataFrame, hops: int, floor: float, n: int) -> DataFrame:
    """The ``n`` strongest of the paths above ``floor`` from ``start`` to an incident of ``ends``.

    Scores never rise along a path. So the ``n``-th best of the paths of one
    hop is a floor too: what falls below it, ties apart, is not among the
    strongest at any length.
    """
    start = written(start)
    best = strongest(ending(expand_paths(edges, start, 1, F.col("confidence"), floor), ends), n)
    found, last = best.agg(F.count("*"), F.min("score")).first()
    if found == n:
        floor = max(floor, last - 1e-6)
    if "score" in start.columns:
        start = start.where(F.col("score") > floor)
    return strongest(ending(expand_paths(edges, start, hops, F.col("confidence"), floor), ends), n)


def from_incidents(spark, d, start: str, end: str, hops: int, floor: float) -> DataFrame:
    """Causal paths from the incidents where ``start`` holds to those where ``end`` does."""
    i = incidents(spark, d)
    p = expand_paths(leads(spark, d), i.where(start).select(F.col("event_id").alias("root")), hops, F.col("confidence"), floor)
    return ending(p, i.where(end))


def strongest_from(spark, d, start: str, end: str, hops: int, floor: float, n: int) -> DataFrame:
    """The ``n`` strongest of ``from_incidents``."""
    i = incidents(spark, d)
    return strongest_ways(leads(spark, d), i.where(start).select(F.col("event_id").alias("root")), i.where(end), hops, floor, n)


def sql_paths(start: str, end: str, hops: int, floor: float, n: int) -> str:
    """SQL of the ``n`` strongest causal paths; ``start`` selects root, node, hops, ids, score before the causal hops, which number up to ``hops``."""
    return f"""WITH {INCIDENTS}, s AS ({start}),
    p AS (SELECT s.root, e.dst AS node, s.hops + 1 AS hops, list_append(s.ids, e.edge_id) AS ids, s.score * e.c AS score, 1 AS steps FROM s JOIN leads e ON e.src = s.node WHERE s.score * e.c > {floor}
          UNION ALL SELECT p.root, e.dst, p.hops + 1, list_append(p.ids, e.edge_id), p.score * e.c, steps + 1 FROM p JOIN leads e ON e.src = p.node WHERE steps < {hops} AND NOT list_contains(p.ids, e.edge_id) AND p.score * e.c > {floor})
    SELECT root, node, hops, array_to_string(ids, '>') AS path, round(score, 6) AS score FROM p JOIN incidents i ON i.event_id = p.node WHERE {end}
    QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, array_to_string(ids, '>')) <= {n}"""


def sql_from(condition: str) -> str:
    return f"SELECT event_id AS root, event_id AS node, 0 AS hops, []::VARCHAR[] AS ids, 1.0::DOUBLE AS score FROM incidents WHERE {condition}"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


CANAL = "event_type = 'CANAL_DISRUPTION' AND description LIKE '%cold%'"


@query(recursive(sql_paths(sql_from(CANAL), "true", 6, 0.005, 50)))
def canal_closure(spark, d):
    """Ripples of the disruptions whose description names the canal."""
    return strongest_from(spark, d, CANAL, "true", 6, 0.005, 50)


@query(recursive(sql_paths(sql_from("event_type = 'SANCTIONS_DESIGNATION'"), "true", 6, 0.01, 40)))
def sanctions_cascade(spark, d):
    return strongest_from(spark, d, "event_type = 'SANCTIONS_DESIGNATION'", "true", 6, 0.01, 40)


@query(recursive(sql_paths(sql_from("domain = 'social_media'"), "domain IN ('maritime', 'security', 'humanitarian')", 4, 0.01, 30)))
def social_to_physical(spark, d):
    return strongest_from(spark, d, "domain = 'social_media'", "domain IN ('maritime', 'security', 'humanitarian')", 4, 0.01, 30)


HUNGER = "domain = 'humanitarian' AND event_type IN ('FAMINE', 'DISPLACEMENT')"


@query(recursive(sql_paths("SELECT instrument AS root, event_id AS node, 1 AS hops, [edge_id] AS ids, c AS score FROM affects JOIN incidents USING (event_id) WHERE instrument = 3 AND event_type = 'PRICE_ANOMALY'", HUNGER, 5, 0.005, 30)))
def price_to_hunger(spark, d):
    """From one instrument back to the price anomalies that moved it, then on to crises."""
    i = incidents(spark, d)
    moved = affects(spark, d).where("instrument = 3").join(i.where("event_type = 'PRICE_ANOMALY'").hint(SHUFFLED), "event_id")
    start = moved.select(F.col("instrument").alias("root"), F.col("event_id").alias("node"), F.lit(1).alias("hops"), F.array("edge_id").alias("edge_ids"), F.col("c").alias("score"))
    return strongest_ways(leads(spark, d), start, i.where(HUNGER), 5, 0.005, 30)


OPERATES = """SELECT vessel_id, event_id, 'o' || vessel_id::VARCHAR || '-' || event_id::VARCHAR AS edge_id, least(1.0, weight::DOUBLE / 100) AS c FROM contacts"""


@query(with_views("contacts ownership", recursive(sql_paths(f"""
    WITH o AS ({OPERATES}), k AS (SELECT c_custkey AS root FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT root, event_id AS node, 1 AS hops, [edge_id] AS ids, c AS score FROM k JOIN o ON vessel_id = root
    UNION ALL SELECT root, event_id, 2, [w.edge_id, o.edge_id], w.pct / 100.0 * c FROM k JOIN ownership w ON w.src = root JOIN o ON vessel_id = w.dst""", "domain = 'maritime'", 4, 0.01, 30)).replace("WITH RECURSIVE", "WITH", 1), recursive=True))
def cartel_to_maritime(spark, d):
    """Organisations that operate an incident, or control one that does, and what follows at sea."""
    i = incidents(spark, d)
    key = F.concat(F.lit("o"), F.col("vessel_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    o = T.contacts(spark, d).select("vessel_id", "event_id", key.alias("edge_id"), F.least(F.lit(1.0), F.col("weight").cast("double") / 100).alias("c"))
    k = T.load(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("root")).hint(SHUFFLED)
    direct = k.join(o, F.col("vessel_id") == F.col("root")).select("root", F.col("event_id").alias("node"), F.lit(1).alias("hops"), F.array("edge_id").alias("edge_ids"), F.col("c").alias("score"))
    w = T.ownership(spark, d).select("src", "dst", "pct", F.col("edge_id").alias("first"))
    through = k.join(w, F.col("src") == F.col("root")).join(o, F.col("vessel_id") == F.col("dst")).select(
        "root", F.col("event_id").alias("node"), F.lit(2).alias("hops"), F.array("first", "edge_id").alias("edge_ids"), (F.col("pct") / 100 * F.col("c")).alias("score")
    )
    # what falls to the floor in the first hops can't rise again
    start = direct.unionByName(through).where("score > 0.01")
    return strongest_ways(leads(spark, d), start, i.where("domain = 'maritime'"), 4, 0.01, 30)


@query(recursive(f"""WITH {INCIDENTS},
    p AS (SELECT i.event_id AS root, e.dst AS node, 1 AS hops, [e.edge_id] AS ids, e.c AS score FROM incidents i JOIN leads e ON e.src = i.event_id WHERE event_type = 'CARTEL_INTERDICTION' AND e.c > 0.005
          UNION ALL SELECT p.root, e.dst, p.hops + 1, list_append(p.ids, e.edge_id), p.score * e.c FROM p JOIN leads e ON e.src = p.node WHERE p.hops < 5 AND NOT list_contains(p.ids, e.edge_id) AND p.score * e.c > 0.005)
    SELECT p.root AS interdiction_id, p.node AS financial_id, i.event_type AS financial_type, a.instrument, p.hops + 1 AS hops, array_to_string(p.ids, '>') AS path, round(p.score * a.c, 6) AS score
    FROM p JOIN incidents i ON i.event_id = p.node JOIN affects a ON a.event_id = p.node WHERE i.domain = 'financial' AND p.score * a.c > 0.005
    ORDER BY score DESC, path, a.instrument LIMIT 30"""))
def revenue_feedback(spark, d, most=30):
    """The strongest ways from an interdiction through a financial incident to an instrument that it moves."""
    p = from_incidents(spark, d, "event_type = 'CARTEL_INTERDICTION'", "domain = 'financial'", 5, 0.005)
    j = p.join(affects(spark, d).hint(SHUFFLED), F.col("node") == F.col("event_id")).withColumn("s", F.col("score") * F.col("c")).where("s > 0.005")
    kinds = incidents(spark, d).select(F.col("event_id").alias("financial_id"), F.col("event_type").alias("financial_type"))
    ways = j.select(F.col("root").alias("interdiction_id"), F.col("node").alias("financial_id"), "instrument", (F.col("hops") + 1).alias("hops"), F.array_join("edge_ids", ">").alias("path"), F.round("s", 6).alias("score"))
    return ways.orderBy(F.desc("score"), "path", "instrument").limit(most).join(kinds, "financial_id")


@query(with_views("vessels ownership", """
    WITH t AS (SELECT DISTINCT o_custkey AS src, -l_suppkey - 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    e AS (SELECT edge_id, src, dst FROM ownership UNION ALL SELECT 's' || src::VARCHAR || dst::VARCHAR, src, dst FROM t),
    names AS (SELECT vessel_id AS node, name FROM vessels UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier),
    p AS (SELECT vessel_id AS root, e.dst AS node, 1 AS hops, [edge_id] AS ids, [n.name] AS chain FROM vessels JOIN e ON e.src = vessel_id LEFT JOIN names n ON n.node = e.dst WHERE sanctions_status = 'SANCTIONED'
          UNION ALL SELECT root, e.dst, hops + 1, list_append(ids, e.edge_id), list_append(chain, n.name) FROM p JOIN e ON e.src = p.node LEFT JOIN names n ON n.node = e.dst WHERE hops < 4 AND NOT list_contains(ids, e.edge_id))
    SELECT v.name AS person, array_to_string(chain, '>') AS financial_chain, hops AS layers FROM p JOIN vessels v ON v.vessel_id = p.root
    WHERE p.node < 0 ORDER BY layers DESC, p.root, array_to_string(ids, '>') LIMIT 30""", recursive=True))
def money_trail(spark, d, most=30):
    """From sanctioned owners through what they control to those they paid (negative nodes): the longest trails, by name."""
    o, li = T.load(spark, d, "orders"), T.load(spark, d, "lineitem")
    paid = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()
    paid = paid.select(F.concat(F.lit("s"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge_id"), "src", "dst")
    v = T.vessels(spark, d)
    roots = v.where("sanctions_status = 'SANCTIONED'").select(F.col("vessel_id").alias("root"))
    trails = expand_paths(T.ownership(spark, d).select("edge_id", "src", "dst").unionByName(paid), roots, 4).where("node < 0")
    longest = trails.withColumn("path", F.array_join("edge_ids", ">")).orderBy(F.desc("hops"), "root", "path").limit(most)
    names = v.select(F.col("vessel_id").alias("n"), "name").unionByName(T.load(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("n"), F.col("s_name").alias("name")))
    steps = longest.select("root", "path", "hops", F.posexplode("nodes").alias("at", "n")).join(names, "n", "left")
    named = steps.groupBy("root", "path", "hops").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
    return named.select(F.col("s")[0]["name"].alias("person"), F.array_join(F.transform(F.slice("s", 2, 9), lambda x: x["name"]), ">").alias("financial_chain"), F.col("hops").alias("layers"))


@query(with_views("vessels ownership", """
    WITH f AS (SELECT o_custkey AS node, min(o_orderdate) AS since FROM orders GROUP BY 1), e AS (SELECT src AS a, dst AS b FROM ownership UNION SELECT dst, src FROM ownership),
    r AS (SELECT vessel_id AS root, vessel_id AS node, 0 AS hops FROM vessels WHERE sanctions_status = 'SANCTIONED' UNION SELECT r.root, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 3)
    SELECT n.node AS company_id, r.root AS sanctioned, s.since AS sanction_date, n.since AS inc_date, min(r.hops) AS hops FROM r JOIN f s ON s.node = r.root JOIN f n ON n.node = r.node WHERE n.since > s.since GROUP BY ALL""", recursive=True))
def after_sanction(spark, d):
    """Companies set up after the listing of someone within three steps; a first order is the date of either."""
    first = T.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.min("o_orderdate").alias("inc_date"))
    roots = T.vessels(spark, d).where("sanctions_status = 'SANCTIONED'").select(F.col("vessel_id").alias("root"))
    # few are listed, so the search starts from them
    r = reach(T.ownership(spark, d), roots, 3, undirected=True)
    listed = first.select(F.col("node").alias("root"), F.col("inc_date").alias("sanction_date"))
    return r.join(first, "node").join(listed, "root").where("inc_date > sanction_date").select(F.col("node").alias("company_id"), F.col("root").alias("sanctioned"), "sanction_date", "inc_date", "hops")


@query(with_views("contacts ownership", """
    WITH e AS (SELECT vessel_id AS a, -event_id - 1 AS b FROM contacts UNION ALL SELECT src, dst FROM ownership), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), g AS (SELECT a, count(*) AS n FROM s GROUP BY 1)
    SELECT s.a AS vessel_id, least(200, sum(g.n))::BIGINT AS paths FROM s JOIN g ON g.a = s.b WHERE s.a >= 0 GROUP BY 1"""))
def vessel_neighbourhood(spark, d):
    """Paths of one or two steps around each vessel, at most 200 reported.

    A step to a node goes on by each of its other edges: one path and its
    degree less one more, so degrees give the number and no path is listed.
    """
    e = T.contacts(spark, d).select(F.col("vessel_id").alias("a"), (-F.col("event_id") - 1).alias("b")).unionByName(T.ownership(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    s = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = s.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n"))
    return s.where("a >= 0").join(degree, "b").groupBy(F.col("a").alias("vessel_id")).agg(F.least(F.lit(200), F.sum("n")).cast("long").alias("paths"))


@query("""
    WITH l AS (SELECT p_partkey AS entry_id, p_type, lower(trim(p_name)) || ' ' || p_brand || ' ' || p_size::VARCHAR AS name FROM part)
    SELECT entry_id, CASE p_type WHEN 'ECONOMY' THEN 'EU' ELSE 'UN' END AS source, name FROM l WHERE p_type IN ('ECONOMY', 'SMALL') AND name NOT IN (SELECT name FROM l WHERE p_type = 'PROMO')
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_type, entry_id) = 1""")
def new_listings(spark, d):
    """Names of two lists that a third lacks, each from the first list and entry that has it."""
    name = F.concat_ws(" ", F.lower(F.trim("p_name")), "p_brand", F.col("p_size").cast("string"))
    lists = T.load(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), "p_type", name.alias("name"))
    source = F.when(F.col("p_type") == "ECONOMY", "EU").otherwise("UN")
    others = lists.where("p_type in ('ECONOMY', 'SMALL')").join(lists.where("p_type = 'PROMO'").select("name"), "name", "left_anti")
    # the least entry by a partial aggregate: no sort of a name's entries
    first = others.groupBy("name").agg(F.min(F.struct("p_type", "entry_id")).alias("e"))
    return first.select(F.col("e.entry_id").alias("entry_id"), F.col("e.p_type").alias("p_type"), "name").select("entry_id", source.alias("source"), "name")


@query("SELECT event_id, round(greatest(0.01, least(1.0, value / 300) * 0.995) + 1e-9, 6) AS strength FROM events")
def memory_decay(spark, d):
    """One step of forgetting, never below a hundredth; a billionth is added before rounding, as values often end in a half."""
    s = F.least(F.lit(1.0), F.col("value") / 300)
    return T.load(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(0.01), s * 0.995) + 1e-9, 6).alias("strength"))
