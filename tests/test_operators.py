import math
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions import geo, text
from seamark.operators import graph, linkage, stats
from seamark.operators.joins import cell_join, interval_join, or_join, top_per_key
from seamark.operators.paths import expand_paths, reach
from seamark.operators.series import decayed, rolling_z
from seamark.plans.tracks import detect_gaps
from seamark.sinks import exports, merge
from seamark.sources import readers


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_haversine_known_distance_and_antipodes(spark):
    r = spark.range(1).select(
        geo.haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278)).alias("a"), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b")
    ).first()
    assert 5500 < r.a < 5650 and abs(r.b - math.pi * 6371) < 1e-6


def track(*rows):
    t0 = datetime(2026, 1, 1)
    return [(1, i, t0 + timedelta(hours=h), lat, lon, v, nav) for i, (h, lat, lon, v, nav) in enumerate(rows)]


SCHEMA = "vessel_id long, position_id long, ts timestamp, lat double, lon double, speed_kts double, nav_status int"


@pytest.mark.parametrize(
    "rows, cause, flag",
    [
        ([(0, 5.0, -76.0, 15.0, 0), (13, 4.2, -76.8, 10.0, 0)], "AIS_OFF_DELIBERATE", True),
        ([(0, 5.0, -76.0, 0.0, 1), (8, 5.0, -76.0, 0.0, 1)], "TECHNICAL_FAILURE_ANCHORED", False),
        ([(0, 5.0, -76.0, 1.0, 0), (7, 5.0, -75.0, 1.0, 0)], "COVERAGE_GAP", True),
    ],
)
def test_gap_causes(spark, rows, cause, flag):
    got = detect_gaps(spark.createDataFrame(track(*rows), SCHEMA)).collect()
    assert [(r.cause, r.risk_flag) for r in got] == [(cause, flag)]


def test_no_gap_below_threshold(spark):
    assert detect_gaps(spark.createDataFrame(track((0, 5.0, -76.0, 15.0, 0), (2, 5.0, -76.0, 15.0, 0)), SCHEMA)).count() == 0


def test_cell_join_finds_all_within_degrees(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 5, (60, 2)))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 5, (60, 2)))]
    left = spark.createDataFrame(a, "a long, lat double, lon double")
    right = spark.createDataFrame(b, "b long, rlat double, rlon double")
    near = cell_join(left, right, 0.7, ("lat", "lon"), ("rlat", "rlon")).where("abs(lat - rlat) <= 0.7 and abs(lon - rlon) <= 0.7")
    want = {(i, j) for i, x, y in a for j, u, v in b if abs(x - u) <= 0.7 and abs(y - v) <= 0.7}
    got = [(r.a, r.b) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" not in near._jdf.queryExecution().toString() and "NestedLoop" not in near._jdf.queryExecution().toString()


def test_interval_join_is_exact(spark):
    t0 = datetime(2026, 1, 1)
    a = spark.createDataFrame([(i, t0 + timedelta(seconds=37 * i)) for i in range(50)], "a long, at timestamp")
    b = spark.createDataFrame([(i, t0 + timedelta(seconds=53 * i)) for i in range(50)], "b long, bt timestamp")
    got = {(r.a, r.b) for r in interval_join(a, b, "at", "bt", 100, 20).collect()}
    assert got == {(i, j) for i in range(50) for j in range(50) if -100 <= 53 * j - 37 * i <= 20}


def test_or_join_and_top(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "a long, k string, m string")
    b = spark.createDataFrame([(1, "x", "p"), (2, "z", "q")], "b long, k2 string, m2 string")
    assert {(r.a, r.b) for r in or_join(a, b, [F.col("k") == F.col("k2"), F.col("m") == F.col("m2")], ["a", "b"]).collect()} == {(1, 1), (2, 2)}
    t = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "g long, v long")
    assert {(r.g, r.v) for r in top_per_key(t, ["g"], [F.desc("v")], 2).collect()} == {(1, 7), (1, 6), (2, 1)}


def brute_paths(edges, root, hops, floor):
    out, stack = [], [(root, (), 1.0)]
    while stack:
        node, ids, w = stack.pop()
        for e, s, d, c in edges:
            if s == node and e not in ids and len(ids) < hops and w * c > floor:
                out.append((d, (*ids, e)))
                stack.append((d, (*ids, e), w * c))
    return sorted(out)


def test_paths_with_cycle_diamond_and_null(spark):
    rows = [("e1", 1, 2, 0.9), ("e2", 2, 3, 0.8), ("e3", 3, 1, 0.9), ("e4", 1, 4, 0.5), ("e5", 4, 3, None), ("e6", 3, 5, 0.3)]
    edges = spark.createDataFrame(rows, "edge_id string, src long, dst long, confidence double")
    roots = spark.createDataFrame([(1,)], "root long")
    got = expand_paths(edges, roots, 5, F.coalesce("confidence", F.lit(0.5)), 0.05)
    filled = [(e, s, d, 0.5 if c is None else c) for e, s, d, c in rows]
    assert sorted((r.node, tuple(r.edge_ids)) for r in got.collect()) == brute_paths(filled, 1, 5, 0.05)
    assert {(r.node, r.hops) for r in reach(edges, roots, 4).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 3)}
    assert (1, 3) in {(r.node, r.hops) for r in reach(edges, roots, 4, with_root=False).collect()}


def test_components_and_betweenness_of_a_line(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 6)] + [(10, 11)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(edges).collect()} == {(i, 1) for i in range(1, 7)} | {(10, 10), (11, 10)}
    line = edges.where("src < 10")
    nodes = line.select(F.col("src").alias("node")).union(line.select("dst")).distinct()
    got = {r.node: r.centrality for r in graph.betweenness(line, nodes).collect()}
    assert [got[i] for i in range(1, 7)] == [0, 8, 12, 12, 8, 0]


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert abs(sum(r["rank"] for r in graph.pagerank(edges, 30).collect()) - 1) < 1e-9


def test_rolling_z_frames(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 10, 5])] + [("b", i, 2.0) for i in range(6)], "k string, i long, v double")
    z = {(r.k, r.i): r.z for r in rolling_z(df, "k", "i", "v", 4).collect()}
    want = (10 - np.mean([2, 3, 4, 10])) / np.std([2, 3, 4, 10], ddof=1)
    assert z["a", 2] is None and abs(z["a", 4] - want) < 1e-9 and z["b", 5] is None
    before = {(r.k, r.i): r.z for r in rolling_z(df, "k", "i", "v", 4, current=False).collect()}
    assert abs(before["a", 4] - (10 - 2.5) / np.std([1, 2, 3, 4], ddof=1)) < 1e-9


def test_decay(spark):
    df = spark.createDataFrame([(0.8, datetime(2026, 1, 1)), (0.8, None), (0.8, datetime(2026, 2, 1))], "c double, t timestamp")
    got = [r.d for r in df.select(decayed(F.col("c"), F.col("t"), "2026-01-11").alias("d")).collect()]
    assert abs(got[0] - 0.8 * 0.98**10) < 1e-9 and got[1:] == [0.8, 0.8]


def test_text_functions(spark):
    r = spark.range(1).select(
        text.company_key(F.lit("  Éclair & Söhne Holdings, Ltd. ")).alias("c"), text.vessel_key(F.lit("M/V Ever-Given 2")).alias("v"), F.size(text.word_chunks(F.lit(" ".join("w" * 1000)), 512, 50)).alias("n"),
        text.jaccard(text.trigrams(F.lit("night")), text.trigrams(F.lit("nightly"))).alias("j"), text.jaccard(F.array(), F.array()).alias("z"), text.confidence_label(F.lit(0.79)).alias("l"),
    ).first()
    assert (r.c, r.v, r.n, r.z, r.l) == ("eclair sohne", "MV EVERGIVEN 2", 3, 0.0, "HIGH") and abs(r.j - 3 / 5) < 1e-9


def test_jaro_winkler_and_em():
    assert abs(linkage.jaro_winkler("MARTHA", "MARHTA") - 0.9611) < 1e-4 and linkage.jaro_winkler("", "a") == 0.0
    rate, m, u = linkage.fit_weights({(1, 1): 90, (0, 0): 900, (1, 0): 5, (0, 1): 5}, [2, 2])
    assert 0.05 < rate < 0.15 and m[0][1] > 0.8 and u[0][1] < 0.1


def test_f_distribution_and_granger():
    assert abs(stats.f_survival(4.0, 2, 10) - 1.8**-5) < 1e-9 and stats.f_survival(0, 2, 3) == 1.0
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = np.r_[0.0, 0.0, 0.8 * x[:-2]] + 0.1 * rng.normal(size=300)
    lag, _, p = stats.granger(x, y, 4)
    assert lag == 2 and p < 1e-6 and stats.granger(y, x, 4)[2] > 1e-3
    assert stats.unit_root(x) < -2.86 < stats.unit_root(np.cumsum(x))


def test_upsert_create_only_and_coalesce(spark):
    t = spark.createDataFrame([(1, "a", 5.0), (2, "b", None)], "id long, made string, v double")
    b = spark.createDataFrame([(1, "z", None), (3, "c", 1.0)], "id long, made string, v double")
    assert {tuple(r) for r in merge.upsert(t, b, ["id"], ["made"]).collect()} == {(1, "a", None), (2, "b", None), (3, "c", 1.0)}
    kept = merge.upsert(t, b, ["id"], ["made"], keep_known=True)
    assert {tuple(r) for r in kept.collect()} == {(1, "a", 5.0), (2, "b", None), (3, "c", 1.0)}
    assert {tuple(r) for r in merge.upsert(kept, b, ["id"], ["made"], keep_known=True).collect()} == {tuple(r) for r in kept.collect()}


def test_split_valid(spark):
    rows = spark.createDataFrame([("123456789", 5.0), ("12345", 91.0), (None, 1.0)], "mmsi string, lat double")
    good, bad = merge.split_valid(rows, {"mmsi": F.col("mmsi").rlike("^[0-9]{9}$"), "lat": F.col("lat").between(-90, 90)}, "ais")
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["mmsi", "mmsi,lat"]


def test_uuid5(spark):
    got = [r.u for r in spark.createDataFrame([("https://vessel/1",), ("x",), ("ü",)], "n string").select(exports.uuid5(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in ("https://vessel/1", "x", "ü")]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "Deal_ID string, NAME string")
    r = readers.resolve_columns(df, {"id": ["id", "deal_id"], "name": ["NAME"], "year": ["year"]}).first()
    assert (r.id, r.name, r.year) == ("1", "x", None)
    (tmp_path / "g.tsv").write_text("1\ta\t2.5\n2\tb\n")
    assert [tuple(x) for x in readers.tab_separated(spark, str(tmp_path / "g.tsv"), "id int, s string, v double").orderBy("id").collect()] == [(1, "a", 2.5), (2, "b", None)]
    (tmp_path / "e.json").write_text('{"id":"1","schema":"Person","properties":{"name":["A","B"],"weakAlias":["C"]}}\nbroken\n{"id":"2","schema":"Ship","properties":{}}\n')
    e = readers.entities(readers.json_lines(spark, str(tmp_path / "e.json"), "id string, schema string, properties map<string,array<string>>", ["Person", "Ship"])).orderBy("id").collect()
    assert [(x.id, x.name, x.aliases) for x in e] == [("1", "A", ["B", "C"]), ("2", None, [])]
    (tmp_path / "l.xml").write_text("<L><R><LEI>1</LEI></R><R><LEI>2</LEI></R></L>")
    assert readers.xml_rows(spark, str(tmp_path / "l.xml"), "R", "LEI string").count() == 2
    u = spark.createDataFrame([("t", "a", "b", None, "", "1", "2", "3", "4")], "title string, owner_1 string, owner_2 string, owner_3 string, owner_4 string, reg_1 string, reg_2 string, reg_3 string, reg_4 string")
    assert sorted(x.owner for x in readers.unpivot_owners(u).collect()) == ["a", "b"]
    d = spark.createDataFrame([("2024-02-01", "$1,200.5"), ("01/02/2024", "x"), ("20240201", None)], "d string, n string").select(readers.multi_format_date(F.col("d")).cast("string").alias("d"), readers.lenient_number(F.col("n"), 0.0).alias("n")).collect()
    assert [x.d for x in d] == ["2024-02-01"] * 3 and [x.n for x in d] == [1200.5, 0.0, 0.0]


def test_drone_frames(spark):
    import struct

    basic = bytes([0x00, 0x12]) + b"DRONE1".ljust(20, b"\0") + bytes(3)
    place = bytes([0x10, 0, 0, 0, 0]) + struct.pack("<ii", int(12.5e7), int(-90.25e7)) + struct.pack("<H", 2200) + bytes(10)
    got = readers.drone_frames(spark.createDataFrame([(bytearray(basic),), (bytearray(place),), (bytearray(b"\0"),)], "frame binary")).collect()
    assert [r.message for r in got] == ["BASIC_ID", "LOCATION"] and got[0].uas_id == "DRONE1"
    assert abs(got[1].lat - 12.5) < 1e-9 and abs(got[1].lon + 90.25) < 1e-9 and got[1].altitude_m == 100.0


def test_hot_queries_stay_in_the_jvm_and_push_filters(spark, small):
    from seamark.plans import QUERIES

    for name in ("gap_summary", "net_behaviour_score", "vessel_risk", "track_points", "composite_matches"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = QUERIES["volume_by_country"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan


def test_near_join_loses_no_pair(spark):
    """Any latitude, across 180 degrees: all pairs inside the radius, as by comparing all with all."""
    import numpy as np
    from pyspark.sql import functions as F

    from seamark.functions.geo import haversine_km
    from seamark.operators.joins import near_join

    rng = np.random.default_rng(3)
    lat = np.r_[rng.uniform(-90, 90, 120), rng.uniform(85, 90, 60), rng.uniform(-5, 5, 60)]
    lon = np.r_[rng.uniform(-180, 180, 180), rng.choice([-179.9, 179.9, 179.5], 60)]
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lat, lon))], "a int, lat double, lon double")
    b = a.select(F.col("a").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    for radius in (30, 700):
        got = near_join(a, b, radius, right_on=("b_lat", "b_lon")).where(km <= radius).select("a", "b")
        want = a.crossJoin(b).where(km <= radius).select("a", "b")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
