"""Merges and exports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark import tables as T
from seamark.plans.registry import query
from seamark.sinks import exports, graph, merge
from seamark.tables import with_views


@query("""
    WITH base AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, min(ts) AS created, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 3 > 0 GROUP BY 1),
    new AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(ts, (ts, event_id)) AS created, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 4 > 0 GROUP BY 1)
    SELECT coalesce(b.user_id, n.user_id) AS user_id, coalesce(n.kind, b.kind) AS kind, coalesce(b.created, n.created) AS created, coalesce(n.value, b.value) AS value FROM base b FULL JOIN new n ON b.user_id = n.user_id""")
def merged_state(spark, d):
    """A keyed table after one batch: creation time stays, the rest is overwritten."""
    e = T.load(spark, d, "events")
    old = e.where("ts < timestamp_ntz'2024-01-15' and user_id % 3 > 0")
    base = merge.latest(old.select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created"), "value", "event_id"), ["user_id"], ["created", "event_id"])
    first = old.groupBy("user_id").agg(F.min("ts").alias("first"))
    base = base.join(first, "user_id").select("user_id", "kind", F.col("first").alias("created"), "value")
    new = e.where("ts >= timestamp_ntz'2024-01-15' and user_id % 4 > 0").select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created"), "value", "event_id")
    return merge.upsert(base, merge.latest(new, ["user_id"], ["created", "event_id"]), ["user_id"], create_only=["created"])


@query("""
    WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind, CASE WHEN value > 80 THEN NULL ELSE value END AS value FROM events)
    SELECT user_id, arg_max(kind, (ts, event_id)) FILTER (kind IS NOT NULL) AS kind, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM e GROUP BY 1""")
def known_state(spark, d):
    """Per vessel and column the last value that is known."""
    e = T.load(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.when(F.col("value") <= 80, F.col("value")).alias("value"))
    return merge.latest_known(e, ["user_id"], ["ts", "event_id"]).select("user_id", "kind", "value")


@query("SELECT 'events' AS source, CASE WHEN value > 100 AND event_type = 'error' THEN 'value,kind' WHEN value > 100 THEN 'value' ELSE 'kind' END AS error, count(*) AS n FROM events WHERE value > 100 OR event_type = 'error' GROUP BY ALL")
def dead_letter_counts(spark, d):
    _, bad = merge.split_valid(T.load(spark, d, "events"), {"value": F.col("value") <= 100, "kind": F.col("event_type") != "error"}, "events")
    return bad.groupBy("source", "error").agg(F.count("*").alias("n"))


@query()
def stix_bundle(spark, d):
    """STIX indicators of sanctioned vessels; no SQL, as DuckDB has no SHA-1 of bytes."""
    return exports.stix_indicators(T.vessels(spark, d).where("sanctions_status = 'SANCTIONED'"), "2024-01-31T00:00:00Z")


@query(with_views("vessels", """SELECT vessel_id, '<urn:vessel:' || mmsi || '> a eucise:Vessel ; eucise:name "' || name || '" ; eucise:flag "' || flag || '" ; eucise:risk "' || printf('%.2f', risk_score) || '"^^xsd:decimal .' AS turtle FROM vessels"""))
def turtle_vessels(spark, d):
    return exports.vessel_turtle(T.vessels(spark, d))


@query(with_views("positions", """
    SELECT position_id, '<event version="2.0" uid="P' || position_id::VARCHAR || '" type="' || CASE WHEN value > 200 THEN 'a-h-S' WHEN nav_status > 5 THEN 'a-s-S' ELSE 'a-n-S' END || '" time="' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"><point lat="' || printf('%.4f', round(lat, 4)) || '" lon="' ||
           printf('%.4f', round(lon, 4)) || '"/><detail><remarks>' || event_type || ' &amp; ' || nav_status::VARCHAR || '</remarks></detail></event>' AS cot FROM positions"""))
def cot_positions(spark, d):
    p = T.positions(spark, d)
    kind = F.when(F.col("value") > 200, "a-h-S").when(F.col("nav_status") > 5, "a-s-S").otherwise("a-n-S")
    body = exports.cot_event(F.concat(F.lit("P"), F.col("position_id").cast("string")), kind, F.round("lat", 4), F.round("lon", 4), F.col("ts"), F.concat("event_type", F.lit(" & "), F.col("nav_status").cast("string")))
    return p.select("position_id", body.alias("cot"))


FLEET = """fleet AS (SELECT 'v' || vessel_id::VARCHAR AS node, CASE WHEN vessel_id % 3 > 0 THEN 9000000 + vessel_id END AS imo, CASE WHEN vessel_id % 4 > 0 THEN mmsi END AS mmsi, name, sanctions_status AS status FROM vessels WHERE vessel_id % 5 > 0),
    listed AS (SELECT vessel_id AS n, CASE WHEN vessel_id % 2 = 0 THEN 9000000 + vessel_id END AS imo, CASE WHEN vessel_id % 7 > 0 THEN mmsi END AS mmsi, 'L ' || name AS name FROM vessels WHERE vessel_id % 3 = 0 OR vessel_id % 5 = 0)"""


@query(with_views("vessels", f"""
    WITH {FLEET},
    one AS (SELECT imo, arg_max({{'mmsi': mmsi, 'name': name}}, n) AS l, arg_min({{'mmsi': mmsi, 'name': name}}, n) AS f FROM listed WHERE imo IS NOT NULL GROUP BY 1),
    a AS (SELECT node, fleet.imo, mmsi, name, CASE WHEN one.imo IS NOT NULL THEN 'SANCTIONED' ELSE status END AS status FROM fleet LEFT JOIN one ON one.imo = fleet.imo
          UNION ALL SELECT 'imo:' || imo::VARCHAR, imo, f.mmsi, f.name, 'SANCTIONED' FROM one WHERE imo NOT IN (SELECT imo FROM fleet WHERE imo IS NOT NULL)),
    two AS (SELECT mmsi, arg_min(name, n) AS name FROM listed WHERE imo IS NULL AND mmsi IS NOT NULL GROUP BY 1)
    SELECT node, imo, a.mmsi, a.name, CASE WHEN two.mmsi IS NOT NULL THEN 'SANCTIONED' ELSE status END AS status FROM a LEFT JOIN two ON two.mmsi = a.mmsi
    UNION ALL SELECT 'mmsi:' || mmsi, NULL, mmsi, name, 'SANCTIONED' FROM two WHERE mmsi NOT IN (SELECT mmsi FROM a WHERE mmsi IS NOT NULL)"""))
def sanctions_merged(spark, d):
    """The fleet after a list is merged by IMO number, or by MMSI where it has none: listed vessels are marked or made."""
    v = T.vessels(spark, d)
    k = F.col("vessel_id")
    fleet = v.where("vessel_id % 5 > 0").select(F.concat(F.lit("v"), k.cast("string")).alias("node"), F.when(k % 3 > 0, k + 9_000_000).alias("imo"), F.when(k % 4 > 0, F.col("mmsi")).alias("mmsi"), "name", F.col("sanctions_status").alias("status"))
    listed = v.where("vessel_id % 3 = 0 or vessel_id % 5 = 0").select(k.alias("n"), F.when(k % 2 == 0, k + 9_000_000).alias("imo"), F.when(k % 7 > 0, F.col("mmsi")).alias("mmsi"), F.concat(F.lit("L "), "name").alias("name"), F.lit("SANCTIONED").alias("status"))
    return graph.merge_nodes(fleet, listed, ["imo", "mmsi"], ["n"], set_columns=["status"], create_columns=["mmsi", "name"])


@query(with_views("vessels contacts", f"""
    WITH {FLEET}, e AS (SELECT c.vessel_id, event_id, mmsi FROM contacts c JOIN vessels v ON v.vessel_id = c.vessel_id),
    m AS (SELECT DISTINCT mmsi FROM e WHERE vessel_id % 2 = 0), n AS (SELECT node, mmsi FROM fleet UNION ALL SELECT 'mmsi:' || mmsi, mmsi FROM m WHERE mmsi NOT IN (SELECT mmsi FROM fleet WHERE mmsi IS NOT NULL)),
    i AS (SELECT DISTINCT node, event_id FROM e JOIN n ON n.mmsi = e.mmsi WHERE vessel_id % 2 = 0)
    SELECT node, count(*) AS events, min(event_id) AS first_event FROM i GROUP BY 1"""))
def event_edges(spark, d):
    """Events tied to their vessel, which is made if the fleet does not have it: edges per vessel."""
    v = T.vessels(spark, d)
    k = F.col("vessel_id")
    fleet = v.where("vessel_id % 5 > 0").select(F.concat(F.lit("v"), k.cast("string")).alias("node"), F.when(k % 3 > 0, k + 9_000_000).alias("imo"), F.when(k % 4 > 0, F.col("mmsi")).alias("mmsi"), "name", F.col("sanctions_status").alias("status"))
    told = T.contacts(spark, d).where("vessel_id % 2 = 0").join(v.select("vessel_id", "mmsi"), "vessel_id").select("mmsi", "event_id")
    nodes = graph.merge_nodes(fleet, told, ["mmsi"], ["event_id"])
    edges = graph.node_edges(nodes, told, ["mmsi"], "event_id", "INVOLVED_IN")
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("events"), F.min(F.col("dst").cast("long")).alias("first_event"))
