"""Loading the driver's tables and deriving the maritime model from them.

Nodes, edges and event tables are derived by plain arithmetic on keys, so that
the same tables can be written in SQL: ``VIEWS`` has the SQL of each.
Reference times are constants, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for the tracks (events) and for the orders.
AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel nodes, one per customer; the flag's number leads the MMSI."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    score = F.least(F.greatest(F.col("c_acctbal") / 1000, F.lit(0.0)), F.lit(10.0))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("vessel_id"),
        F.concat((F.col("n_nationkey") + 400).cast("string"), F.lpad(k.cast("string"), 6, "0")).alias("mmsi"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("flag"),
        F.col("c_mktsegment").alias("vessel_type"),
        F.concat(F.lit("Owner "), (k % 97).cast("string")).alias("owner_name"),
        # in whole hundredths, as SQL rounds: the decimal 8.495 is a double below the half, and a zero keeps its sign
        F.when(score == 0, score).otherwise(F.round(score * 100) / 100).alias("risk_score"),
        F.when(k % 41 == 0, "SANCTIONED").when(k % 13 == 0, "WATCH").otherwise("CLEAR").alias("sanctions_status"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIS positions, one per event; each vessel moves inside its own square."""
    e, u = F.col("event_id"), F.col("user_id")
    return load(spark, sf_dir, "events").select(
        e.alias("position_id"),
        u.alias("vessel_id"),
        "ts",
        (F.lit(5.0) + u % 20 + (e * 37 % 1000) / 1000.0).alias("lat"),
        (F.lit(-80.0) + u % 30 + (e * 91 % 1000) / 1000.0).alias("lon"),
        (F.col("value") / 10.0).alias("speed_kts"),
        (e % 8).cast("int").alias("nav_status"),
        "event_type",
        "value",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel-to-event edges: a customer takes part in the event of every part it ordered."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .groupBy(F.col("o_custkey").alias("vessel_id"), F.col("l_partkey").alias("event_id"))
        .agg(F.min("l_shipdate").alias("seen"), F.sum("l_quantity").alias("weight"))
    )


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner-to-owned edges: a forest with some cross holdings and cycles."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = F.lit(97)
    tree = c.where("k > 0").select(
        F.concat(F.lit("t"), F.col("k").cast("string")).alias("edge_id"), F.floor(F.col("k") / 4).cast("long").alias("src"), F.col("k").alias("dst"), (F.lit(51.0) + F.col("k") % 49).alias("pct")
    )
    cross = c.where("k % 29 = 0 and k < 290").select(
        F.concat(F.lit("x"), F.col("k").cast("string")).alias("edge_id"), F.col("k").alias("src"), ((F.col("k") * 7 + 3) % n).alias("dst"), (F.lit(10.0) + F.col("k") % 40).alias("pct")
    )
    return tree.unionByName(cross)


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cause-to-effect edges between suppliers' event types, with confidences below one."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    size = s.agg(F.max("k") + 1).scalar()
    parts = [
        s.select(F.concat(F.lit(p), F.col("k").cast("string")).alias("edge_id"), F.col("k").alias("src"), ((F.col("k") * m + a) % size).alias("dst"), conf.alias("confidence"))
        for p, m, a, conf in (
            ("a", 3, 1, F.when(F.col("k") % 11 == 0, None).otherwise((F.col("k") % 7 + 3) / 10.0)),
            ("b", 7, 5, (F.col("k") % 5 + 4) / 10.0),
        )
    ]
    return parts[0].unionByName(parts[1]).where("src <> dst")


VIEWS = {
    "vessels": """vessels AS (
        SELECT c_custkey AS vessel_id, (n_nationkey + 400)::VARCHAR || lpad(c_custkey::VARCHAR, 6, '0') AS mmsi, c_name AS name, n_name AS flag,
               c_mktsegment AS vessel_type, 'Owner ' || (c_custkey % 97)::VARCHAR AS owner_name,
               round(least(greatest(c_acctbal / 1000, 0.0), 10.0), 2) AS risk_score,
               CASE WHEN c_custkey % 41 = 0 THEN 'SANCTIONED' WHEN c_custkey % 13 = 0 THEN 'WATCH' ELSE 'CLEAR' END AS sanctions_status
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "positions": """positions AS (
        SELECT event_id AS position_id, user_id AS vessel_id, ts, 5.0::DOUBLE + user_id % 20 + (event_id * 37 % 1000) / 1000.0::DOUBLE AS lat,
               -80.0::DOUBLE + user_id % 30 + (event_id * 91 % 1000) / 1000.0::DOUBLE AS lon, value / 10.0::DOUBLE AS speed_kts,
               (event_id % 8)::INT AS nav_status, event_type, value
        FROM events)""",
    "contacts": """contacts AS (
        SELECT o_custkey AS vessel_id, l_partkey AS event_id, min(l_shipdate) AS seen, sum(l_quantity) AS weight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
    "ownership": """ownership AS (
        SELECT 't' || c_custkey::VARCHAR AS edge_id, c_custkey // 4 AS src, c_custkey AS dst, 51.0::DOUBLE + c_custkey % 49 AS pct FROM customer WHERE c_custkey > 0
        UNION ALL
        SELECT 'x' || c_custkey::VARCHAR, c_custkey, (c_custkey * 7 + 3) % 97, 10.0::DOUBLE + c_custkey % 40 FROM customer WHERE c_custkey % 29 = 0 AND c_custkey < 290)""",
    "causes": """causes AS (
        SELECT * FROM (
            SELECT 'a' || s_suppkey::VARCHAR AS edge_id, s_suppkey AS src, (s_suppkey * 3 + 1) % (SELECT max(s_suppkey) + 1 FROM supplier) AS dst,
                   CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey % 7 + 3) / 10.0::DOUBLE END AS confidence FROM supplier
            UNION ALL
            SELECT 'b' || s_suppkey::VARCHAR, s_suppkey, (s_suppkey * 7 + 5) % (SELECT max(s_suppkey) + 1 FROM supplier), (s_suppkey % 5 + 4) / 10.0::DOUBLE FROM supplier)
        WHERE src <> dst)""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL whose first common table expressions are the named views."""
    heads = ",\n".join(VIEWS[n] for n in names.split())
    body = body.strip()
    tail = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}{tail}"


def micros(column: str | Column) -> Column:
    """Microseconds of a time column; times without a zone count in the session's zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))
