"""Path, ownership and graph-algorithm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark import tables as T
from seamark.operators import graph
from seamark.operators.communities import modularity_communities
from seamark.operators.paths import expand_paths, reach
from seamark.plans.registry import query
from seamark.tables import with_views

CASCADE = """p AS (
    SELECT src AS root, dst AS node, 1 AS hops, [edge_id] AS ids, least(coalesce(confidence, 0.5), 1.0)::DOUBLE AS score FROM causes
    UNION ALL
    SELECT p.root, c.dst, p.hops + 1, list_append(p.ids, c.edge_id), p.score * least(coalesce(c.confidence, 0.5), 1.0) FROM p JOIN causes c ON c.src = p.node
    WHERE p.hops < {hops} AND NOT list_contains(p.ids, c.edge_id))"""


def roots_of(spark, d, condition):
    return T.causes(spark, d).where(condition).select(F.col("src").alias("root")).distinct()


def cascade(spark, d, hops, floor, condition="src is not null"):
    return expand_paths(T.causes(spark, d), roots_of(spark, d, condition), hops, F.coalesce("confidence", F.lit(0.5)), floor)


@query(with_views("causes", f"WITH {CASCADE.format(hops=6)} SELECT root, node, hops, array_to_string(ids, '>') AS path, round(score, 6) AS score FROM p WHERE score > 0.01", recursive=True))
def downstream_cascade(spark, d):
    """Every causal path of up to six steps whose confidence stays above 0.01."""
    c = cascade(spark, d, 6, 0.01)
    return c.select("root", "node", "hops", F.array_join("edge_ids", ">").alias("path"), F.round("score", 6).alias("score"))


@query(with_views("causes", f"WITH {CASCADE.format(hops=5)} SELECT root % 7 AS root_type, node % 7 AS node_type, count(*) AS paths, round(max(score), 6) AS best FROM p WHERE score > 0.02 GROUP BY ALL", recursive=True))
def type_cascade(spark, d):
    c = cascade(spark, d, 5, 0.02)
    return c.groupBy((F.col("root") % 7).alias("root_type"), (F.col("node") % 7).alias("node_type")).agg(F.count("*").alias("paths"), F.round(F.max("score"), 6).alias("best"))


@query(with_views("causes", f"""
    WITH {CASCADE.format(hops=4)} SELECT root, node, hops, CASE hops WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 3 THEN 30 ELSE 45 END * hops AS days, round(score, 6) AS score,
    len(list_filter(ids, lambda x: starts_with(x, 'b'))) AS support FROM p QUALIFY row_number() OVER (ORDER BY score DESC, array_to_string(ids, '>')) <= 20""", recursive=True))
def chain_report(spark, d):
    """The twenty strongest chains with their expected delay."""
    c = cascade(spark, d, 4, None).withColumn("path", F.array_join("edge_ids", ">"))
    days = F.when(F.col("hops") == 1, 7).when(F.col("hops") == 2, 14).when(F.col("hops") == 3, 30).otherwise(45) * F.col("hops")
    support = F.size(F.filter("edge_ids", lambda x: x.startswith("b"))).cast("long")
    return c.orderBy(F.desc("score"), "path").limit(20).select("root", "node", "hops", days.alias("days"), F.round("score", 6).alias("score"), support.alias("support"))


@query(with_views("causes", """
    WITH up AS (SELECT src AS root, dst AS mid, coalesce(confidence, 0.5)::DOUBLE AS s1, edge_id AS e1 FROM causes),
    side AS (SELECT root, c.src AS mid, s1, e1 FROM up JOIN causes c ON c.dst = up.mid AND c.edge_id <> up.e1),
    down AS (SELECT root, c.dst AS node, s1 * coalesce(c.confidence, 0.5) AS s2, 1 AS hops, [c.edge_id] AS ids FROM side JOIN causes c ON c.src = side.mid AND c.edge_id <> side.e1
             UNION ALL SELECT root, c.dst, s2 * coalesce(c.confidence, 0.5), hops + 1, list_append(ids, c.edge_id) FROM down JOIN causes c ON c.src = down.node WHERE hops < 3 AND NOT list_contains(ids, c.edge_id))
    SELECT root, node, count(*) AS paths, round(max(s2), 6) AS best FROM down WHERE s2 > 0.05 GROUP BY ALL""", recursive=True))
def mixed_direction_cascade(spark, d):
    """Forward, back over a shared effect, then forward again."""
    c = T.causes(spark, d).withColumn("w", F.coalesce("confidence", F.lit(0.5)))
    up = c.select(F.col("src").alias("root"), F.col("dst").alias("mid"), F.col("w").alias("s1"), F.col("edge_id").alias("e1"))
    side = up.join(c.select(F.col("dst").alias("mid"), F.col("src").alias("back"), "edge_id"), "mid").where("edge_id <> e1").select("root", F.col("back").alias("mid"), "s1", "e1")
    e = c.select("edge_id", F.col("src").alias("f"), F.col("dst").alias("t"), "w")
    level = side.join(e, (F.col("mid") == F.col("f")) & (F.col("edge_id") != F.col("e1"))).select("root", F.col("t").alias("node"), (F.col("s1") * F.col("w")).alias("s2"), F.array("edge_id").alias("ids")).where("s2 > 0.05")
    out = level
    for _ in range(2):
        level = level.join(e, (F.col("node") == F.col("f")) & ~F.array_contains("ids", F.col("edge_id")))
        level = level.select("root", F.col("t").alias("node"), (F.col("s2") * F.col("w")).alias("s2"), F.array_append("ids", F.col("edge_id")).alias("ids")).where("s2 > 0.05")
        out = out.unionByName(level)
    return out.groupBy("root", "node").agg(F.count("*").alias("paths"), F.round(F.max("s2"), 6).alias("best"))


OWNERS = """up AS (
    SELECT dst AS root, src AS node, 1 AS hops, [edge_id] AS ids, pct / 100.0::DOUBLE AS share FROM ownership
    UNION ALL
    SELECT up.root, o.src, up.hops + 1, list_append(up.ids, o.edge_id), up.share * o.pct / 100.0 FROM up JOIN ownership o ON o.dst = up.node WHERE up.hops < 10 AND NOT list_contains(up.ids, o.edge_id))"""


def upward(edges):
    """Edges from owned to owner."""
    return edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "pct")


def owned(spark, d):
    return T.ownership(spark, d).select(F.col("dst").alias("root")).distinct()


@query(with_views("ownership", f"WITH {OWNERS} SELECT DISTINCT root, node AS owner, hops, round(share * 100 + 1e-9, 3) AS pct FROM up WHERE node = 0 OR node % 5 = 0", recursive=True))
def ultimate_owners(spark, d):
    """Owners at any depth with their effective share: persons (every fifth node) and the root company.

    A billionth is added before rounding, as products of whole percents often end in a half.
    """
    p = expand_paths(upward(T.ownership(spark, d)), owned(spark, d), 10, F.col("pct") / 100)
    return p.where("node = 0 or node % 5 = 0").select("root", F.col("node").alias("owner"), "hops", F.round(F.col("score") * 100 + 1e-9, 3).alias("pct")).distinct()


TREE = """WITH t AS (SELECT {far} AS node, 1 AS level, [edge_id] AS ids, [{near}, {far}] AS nodes, pct FROM ownership WHERE {near} = {root}
                  UNION ALL SELECT o.{far}, level + 1, list_append(ids, o.edge_id), list_append(nodes, o.{far}), o.pct FROM t JOIN ownership o ON o.{near} = t.node WHERE level < 10 AND NOT list_contains(ids, o.edge_id))
    SELECT node, level, round(pct, 4) AS last_pct, array_to_string(ids, '>') AS edges, array_to_string(nodes, '>') AS chain FROM t"""


def ownership_tree(edges, root, levels=10):
    """Every way of up to ten holdings from ``root``, with the share of the last one; ``edges`` point away from it."""
    p = expand_paths(edges, edges.where(F.col("src") == root).select(F.col("src").alias("root")).distinct(), levels)
    last = edges.select(F.col("edge_id").alias("last"), "pct")
    ways = p.withColumn("last", F.element_at("edge_ids", -1)).join(last, "last")
    return ways.select("node", F.col("hops").alias("level"), F.round("pct", 4).alias("last_pct"), F.array_join("edge_ids", ">").alias("edges"), F.array_join(F.col("nodes").cast("array<string>"), ">").alias("chain"))


@query(with_views("ownership", TREE.format(near="src", far="dst", root=3), recursive=True))
def ownership_tree_down(spark, d, root=3):
    return ownership_tree(T.ownership(spark, d), root)


@query(with_views("ownership", TREE.format(near="dst", far="src", root=90), recursive=True))
def ownership_tree_up(spark, d, root=90):
    return ownership_tree(upward(T.ownership(spark, d)), root)


@query(with_views("ownership", f"WITH {OWNERS} SELECT root, node AS owner, min(hops) AS depth FROM up GROUP BY ALL", recursive=True))
def ownership_unmask(spark, d):
    """Each owner once, at its smallest depth: reachability is enough, so paths are not enumerated."""
    r = reach(upward(T.ownership(spark, d)), owned(spark, d), 10, with_root=False)
    return r.select("root", F.col("node").alias("owner"), F.col("hops").alias("depth"))


@query(with_views("ownership", """
    WITH e AS (SELECT src AS a, dst AS b FROM ownership UNION SELECT dst, src FROM ownership),
    r AS (SELECT DISTINCT a AS root, a AS node, 0 AS hops FROM e UNION SELECT r.root, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 3),
    m AS (SELECT root, min(hops) AS hops FROM r WHERE node % 41 = 0 GROUP BY 1)
    SELECT s.root, coalesce(m.hops, -1) AS hops, CASE WHEN m.hops IS NULL THEN 'NONE' WHEN m.hops <= 1 THEN 'CRITICAL' WHEN m.hops = 2 THEN 'HIGH' WHEN m.hops = 3 THEN 'MEDIUM' ELSE 'LOW' END AS level
    FROM (SELECT DISTINCT root FROM r) s LEFT JOIN m ON m.root = s.root""", recursive=True))
def sanctions_proximity(spark, d):
    """Distance to the nearest sanctioned node (every 41st), ignoring direction."""
    o = T.ownership(spark, d)
    nodes = o.select(F.col("src").alias("root")).union(o.select("dst")).distinct()
    m = reach(o, nodes, 3, undirected=True).where("node % 41 = 0").groupBy("root").agg(F.min("hops").alias("hops"))
    level = F.when(F.col("hops").isNull(), "NONE").when(F.col("hops") <= 1, "CRITICAL").when(F.col("hops") == 2, "HIGH").when(F.col("hops") == 3, "MEDIUM").otherwise("LOW")
    return nodes.join(m, "root", "left").select("root", F.coalesce("hops", F.lit(-1)).alias("hops"), level.alias("level"))


@query(with_views("ownership", f"WITH {OWNERS} SELECT root, max(hops) AS depth, count(*) FILTER (node = root) > 0 AS circular, CASE WHEN max(hops) > 2 THEN 0.5 * (max(hops) - 2) ELSE 0.0 END + CASE WHEN count(*) FILTER (node = root) > 0 THEN 3.0 ELSE 0.0 END AS score FROM up GROUP BY 1", recursive=True))
def ownership_opacity(spark, d):
    """Longest chain above a company and whether it owns itself."""
    p = expand_paths(upward(T.ownership(spark, d)), owned(spark, d), 10)
    g = p.groupBy("root").agg(F.max("hops").alias("depth"), (F.count_if(F.col("node") == F.col("root")) > 0).alias("circular"))
    return g.withColumn("score", F.when(F.col("depth") > 2, 0.5 * (F.col("depth") - 2)).otherwise(0.0) + F.when(F.col("circular"), 3.0).otherwise(0.0))


@query(with_views("ownership", """
    WITH p AS (SELECT src AS root, dst AS node, 1 AS hops, [src, dst] AS nodes, [edge_id] AS ids FROM ownership
               UNION ALL SELECT root, o.dst, hops + 1, list_append(nodes, o.dst), list_append(ids, o.edge_id) FROM p JOIN ownership o ON o.src = p.node WHERE hops < 4 AND NOT list_contains(ids, o.edge_id))
    SELECT root, node, hops FROM p WHERE hops >= 3 AND len(list_filter(nodes, lambda x: x % 3 = 0)) = 0""", recursive=True))
def shell_chains(spark, d):
    """Chains of three or more companies none of which a person owns (every third node has one)."""
    o = T.ownership(spark, d)
    # a node with a person ends a chain, so such edges go before paths are built
    free = o.where("src % 3 <> 0 and dst % 3 <> 0")
    p = expand_paths(free, free.select(F.col("src").alias("root")).distinct(), 4, min_hops=3)
    return p.select("root", "node", "hops")


@query(with_views("ownership", """
    WITH e AS (SELECT edge_id, src AS a, dst AS b FROM ownership UNION ALL SELECT edge_id, dst, src FROM ownership)
    SELECT DISTINCT x.a AS vessel_id, y.b AS node FROM e x JOIN e y ON y.a = x.b AND y.edge_id <> x.edge_id WHERE x.a % 41 = 0 AND y.b % 41 <> 0
    UNION SELECT DISTINCT a, b FROM e WHERE a % 41 = 0 AND b % 41 <> 0"""))
def sanctioned_two_hop(spark, d):
    o = T.ownership(spark, d)
    p = expand_paths(o, o.select(F.col("src").alias("root")).union(o.select("dst")).distinct().where("root % 41 = 0"), 2, undirected=True)
    return p.where("node % 41 <> 0").select(F.col("root").alias("vessel_id"), "node").distinct()


@query(with_views("causes", """
    WITH s AS (SELECT a.src % 9 AS t1, a.dst % 9 AS t2, b.dst % 9 AS t3, count(*) AS n, avg((coalesce(a.confidence, 0) + b.confidence) / 2) AS c FROM causes a JOIN causes b ON b.src = a.dst
               WHERE a.confidence >= 0.5 AND b.confidence >= 0.5 GROUP BY ALL)
    SELECT t1, t2, t3, n, round(least(0.9, n / (3.0 * 2)), 4) AS confidence FROM s WHERE n >= 2"""))
def emerging_sequences(spark, d):
    c = T.causes(spark, d).where("confidence >= 0.5")
    b = c.select(F.col("src").alias("mid"), F.col("dst").alias("last"))
    g = c.join(b, F.col("dst") == F.col("mid")).groupBy((F.col("src") % 9).alias("t1"), (F.col("dst") % 9).alias("t2"), (F.col("last") % 9).alias("t3")).agg(F.count("*").alias("n")).where("n >= 2")
    return g.withColumn("confidence", F.round(F.least(F.lit(0.9), F.col("n") / 6.0), 4))


@query(with_views("causes", """
    WITH v AS (SELECT edge_id, coalesce(confidence, 0.5) AS c, src, dst FROM causes)
    SELECT edge_id, round(CASE WHEN EXISTS (SELECT 1 FROM causes x WHERE x.src = v.dst AND x.dst = v.src) THEN greatest(0.01, c - 0.08) WHEN src % 2 = 0 THEN least(0.99, c + 0.05) ELSE greatest(0.05, c * 0.97) END, 5) AS confidence,
           CASE WHEN EXISTS (SELECT 1 FROM causes x WHERE x.src = v.dst AND x.dst = v.src) THEN 'CONTRADICTED' WHEN src % 2 = 0 THEN 'VALIDATED' ELSE 'AGED' END AS change FROM v"""))
def learning_cycle(spark, d):
    """Edges validated, contradicted or aged: one new version of the edge table."""
    c = T.causes(spark, d).withColumn("c", F.coalesce("confidence", F.lit(0.5)))
    back = T.causes(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("against")).distinct()
    j = c.join(back, ["src", "dst"], "left")
    new = F.when(F.col("against"), F.greatest(F.lit(0.01), F.col("c") - 0.08)).when(F.col("src") % 2 == 0, F.least(F.lit(0.99), F.col("c") + 0.05)).otherwise(F.greatest(F.lit(0.05), F.col("c") * 0.97))
    change = F.when(F.col("against"), "CONTRADICTED").when(F.col("src") % 2 == 0, "VALIDATED").otherwise("AGED")
    return j.select("edge_id", F.round(new, 5).alias("confidence"), change.alias("change"))


PAGERANK = """l AS MATERIALIZED (SELECT DISTINCT src, dst FROM causes), n AS MATERIALIZED (SELECT node, (SELECT count(*) FROM l WHERE src = node) AS out FROM (SELECT src AS node FROM l UNION SELECT dst FROM l)),
c AS (SELECT count(*)::DOUBLE AS n FROM n), r0 AS MATERIALIZED (SELECT node, out, 1.0 / c.n AS rank FROM n, c)""" + "".join(f""",
r{k} AS MATERIALIZED (SELECT n.node, n.out, (0.15 + 0.85 * (SELECT coalesce(sum(rank) FILTER (out = 0), 0) FROM r{k - 1})) / c.n + 0.85 * coalesce(g.got, 0) AS rank
       FROM c, n LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM l JOIN r{k - 1} ON src = node GROUP BY 1) g ON g.dst = n.node)""" for k in range(1, 11))


@query(with_views("causes", f"WITH {PAGERANK} SELECT node, round(rank, 8) AS rank FROM r10"))
def page_rank(spark, d):
    return graph.pagerank(T.causes(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query(with_views("contacts", """
    WITH e AS (SELECT vessel_id AS a, -event_id - 1 AS b FROM contacts), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT DISTINCT a AS node, a AS low FROM s WHERE a < 0 UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.node), c AS (SELECT node, min(low) AS component FROM r GROUP BY 1)
    SELECT component, count(*) AS size FROM c GROUP BY 1""", recursive=True))
def contact_components(spark, d):
    """Components of the vessel-event graph; events are negative nodes."""
    e = T.contacts(spark, d).select(F.col("vessel_id").alias("src"), (-F.col("event_id") - 1).alias("dst"))
    return graph.connected_components(e).groupBy("component").agg(F.count("*").alias("size"))


@query()
def communities(spark, d):
    """Communities of the graph of effects by modularity, with their size and smallest node; no SQL, as nodes move in rounds."""
    found = modularity_communities(T.causes(spark, d))
    return found.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first"))


@query()
def betweenness_centrality(spark, d):
    """Dependencies from every node over ways of any length; no SQL, as they flow back level by level."""
    c = T.causes(spark, d)
    nodes = c.select(F.col("src").alias("node")).union(c.select("dst")).distinct()
    return graph.betweenness(c, nodes).select("node", F.round("centrality", 6).alias("centrality"))
