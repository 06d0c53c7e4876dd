"""What only shows on tables larger than the smallest scale: on rows made for it, and in the plans."""

import duckdb
import pytest
from compare import same

from seamark.plans import QUERIES, SQL

NATION = "SELECT 0 AS n_nationkey, 'NATION_0' AS n_name, 0 AS n_regionkey"


@pytest.fixture
def tables(tmp_path):
    """A folder of tables from SQL, and a DuckDB connection that has them as views."""

    def make(**sql):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for name, body in sql.items():
            con.sql(f"COPY ({body}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return make


def test_frame_fields_beyond_four_bytes(spark, tables):
    path, con = tables(part="SELECT unnest([0, 1, 542_367, 542_368, 1_199_999, 3_000_000_000])::BIGINT AS p_partkey")
    same(QUERIES["frame_fields"](spark, path), con, SQL["frame_fields"])


HALVES = f"SELECT i::BIGINT AS c_custkey, 'C' || i::VARCHAR AS c_name, 0 AS c_nationkey, [8495.0, 8505.0, 5005.0, 5015.0, 9999.99, -20.0][i]::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(1, 7) r(i)"


@pytest.mark.parametrize("name", ["turtle_vessels"])
def test_scores_of_every_balance(name, spark, tables):
    """All balances in cents from -1,000 to 10,001: rounded as SQL rounds."""
    customer = "SELECT (i + 100000)::BIGINT AS c_custkey, 'C' AS c_name, 0 AS c_nationkey, (i / 100.0)::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(-100000, 1000100, 5) r(i)"
    path, con = tables(customer=customer, nation=NATION)
    same(QUERIES[name](spark, path), con, SQL[name])


@pytest.mark.parametrize("name", ["risk_summary", "turtle_vessels"])
def test_scores_at_half_a_hundredth(name, spark, tables):
    path, con = tables(customer=HALVES, nation=NATION)
    same(QUERIES[name](spark, path), con, SQL[name])


@pytest.mark.parametrize("name", ["risk_summary", "turtle_vessels"])
def test_scores_of_a_negative_zero(name, spark, tables):
    """Balances that are rounded from just below zero keep their sign, which the text shows."""
    customer = "SELECT i::BIGINT AS c_custkey, 'C' AS c_name, 0 AS c_nationkey, ['-0.0', '0.0', '-0.01', '0.01', 'nan', 'inf', NULL][i]::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(1, 8) r(i)"
    path, con = tables(customer=customer, nation=NATION)
    same(QUERIES[name](spark, path), con, SQL[name])


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["close_pairs", "transfer_pairs", "alert_subscriptions"])
def test_exploded_sides_are_not_broadcast(name, spark, small):
    """The size of an exploded side is not known beforehand, so it is shuffled even on small tables."""
    plan = executed(QUERIES[name](spark, small))
    assert "Generate explode" in plan
    assert "BroadcastHashJoin" not in plan


def test_first_near_in_a_crowd(spark):
    """A crowd, a lonely row that looks as far as the window, a row that finds only itself, ties."""
    import math
    from datetime import datetime, timedelta

    from seamark.operators.newest import first_near

    start = datetime(2024, 1, 1)
    crowd = [(i, start + timedelta(seconds=i * 37 % 5000), 10.0 + i % 20 / 10, 10.0 + i % 30 / 10, "ab"[i % 2]) for i in range(800)]
    rows = [*crowd, (900, start - timedelta(days=2), 11.0, 11.0, "a"), (901, start, 60.0, 179.9, "a"), (902, start + timedelta(days=2), 60.0, -179.9, "a"), (903, start, -40.0, 0.0, "a")]
    left = spark.createDataFrame(rows, "l long, made timestamp, plat double, plon double, p_kind string")
    right = left.toDF("r", "ts", "lat", "lon", "kind")
    found = first_near(left, right, 100, 3 * 86400, ("plat", "plon"), ("lat", "lon"), ("made", "ts"), ("p_kind", "kind"), ("l", "r"))
    got = {x["l"]: x["hit"]["id"] for x in found.collect()}

    def km(a, b):
        (p, q), (s, t) = (map(math.radians, x[2:4]) for x in (a, b))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2)))

    want = {}
    for a in rows:
        hits = [(b[1], b[0]) for b in rows if b[0] != a[0] and b[4] == a[4] and a[1] <= b[1] <= a[1] + timedelta(days=3) and km(a, b) <= 100]
        if hits:
            want[a[0]] = min(hits)[1]
    assert got == want and 901 in want and 903 not in want


@pytest.mark.parametrize("name", ["communities", "components"])
def test_loops_keep_the_size_of_their_tables(name, spark):
    """A size that is multiplied from round to round ends in millions of digits."""
    from seamark.operators.communities import modularity_communities
    from seamark.operators.graph import connected_components

    edges = spark.range(40).selectExpr("id as src", "(id + 1) % 40 as dst")
    found = {"communities": modularity_communities, "components": connected_components}[name](edges)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20


def test_pairs_of_safe_houses_are_not_shuffled(spark, tables):
    """Each pair comes from one of the two joins, repeated keys included."""
    customer = "SELECT unnest([1, 1, 5, 701, 2, 9, 1000])::BIGINT AS c_custkey"
    path, con = tables(customer=customer, supplier="SELECT unnest([0, 1, 1, 7, 141, 40])::BIGINT AS s_suppkey")
    found = QUERIES["safe_houses"](spark, path)
    same(found, con, SQL["safe_houses"])
    top = executed(found).split("Union")[0]
    assert "Aggregate" not in top and "Exchange" not in top


def test_components_are_not_broadcast(spark, monkeypatch):
    """Written tables of keys are small as files, so Spark would broadcast millions of rows."""
    from seamark.operators import graph

    plans = []
    monkeypatch.setattr(graph, "written", lambda df, real=graph.written: (plans.append(executed(df)), real(df))[1])
    graph.connected_components(spark.range(40).selectExpr("id as src", "id + 1 as dst")).count()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)




@pytest.mark.parametrize("name", ["canal_closure", "sanctions_cascade", "price_to_hunger", "social_to_physical", "downstream_cascade"])
def test_edges_of_paths_are_not_broadcast(name, spark, small):
    """Edges seem small by the columns that are read of them; a broadcast passes all of them through the driver at each hop."""
    plan = executed(QUERIES[name](spark, small))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_revenue_feedback_broadcasts_its_best_ways_only(spark, small):
    plan = executed(QUERIES["revenue_feedback"](spark, small))
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") >= 3


def test_classes_meet_on_the_first_list_they_share(spark):
    """Classes with many lists in common made a row for each of them."""
    from seamark.llm import ngram_join

    # class k is on the lists k % 3 to 19, in the order of their numbers
    rows = [(t, k, 100, t - k % 3, 40, k, 0, 0, 0, 0) for k in range(30) for t in range(k % 3, 20)]
    lists = spark.createDataFrame(rows, "token long, k long, n int, pos int, left int, lab long, b0 long, b1 long, b2 long, b3 long")
    met = [tuple(r) for r in ngram_join._first_meetings(lists, 4, 5).collect()]
    assert sorted(met) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_few_documents_of_a_search_stay_in_question(spark, tmp_path, monkeypatch):
    """Documents with one of the terms that are looked up asked for the weights of all others; twelve have both."""
    from pyspark.sql import functions as F

    from seamark.operators import search as S

    docs = [(i, "a b c common" if i < 12 else f"{'aaaabbcc'[i % 8]} common f{i} g{i}") for i in range(600)]
    S.write_index(spark.createDataFrame(docs, "d long, text string"), "d", S.words(F.col("text")), str(tmp_path))
    kept = []
    monkeypatch.setattr(S, "written", lambda df, real=S.written: (kept.append(real(df)), kept[-1])[1])
    found = S.search(spark, str(tmp_path), spark.createDataFrame([(1, "a b c common")], "q long, text string"), "q", S.words(F.col("text")))
    assert [r["doc"] for r in found.orderBy("place").collect()] == list(range(10))
    assert kept[-1].count() == 12


def test_components_of_few_nodes_as_of_many(spark, monkeypatch):
    """Labels of few nodes are broadcast, of which a round has one shuffle; those of many are not."""
    from seamark.llm import components as C

    edges = spark.range(60).selectExpr("id as a", "id + 2 as b")
    plans = []
    monkeypatch.setattr(C, "materialize", lambda df, label, real=C.materialize: (plans.append((label, executed(df))), real(df, label))[1])
    want = {(k, k % 2) for k in range(62)}
    assert {tuple(r) for r in C.components(edges).collect()} == want
    assert all("SortMergeJoin" not in p and p.count("Exchange hashpartitioning") == 1 for label, p in plans if label == "cc-labels")
    monkeypatch.setattr(C, "FEW_ROWS", 0)
    assert {tuple(r) for r in C.components(edges).collect()} == want


def test_vessels_meet_the_flags_of_an_event(spark, tables):
    """All vessels of an event met each other; a vessel alone under its flag does not meet that flag."""
    path, con = tables(
        nation="SELECT i::INT AS n_nationkey, 'NATION_' || i AS n_name, 0 AS n_regionkey FROM range(25) r(i)",
        customer="SELECT i::BIGINT AS c_custkey, 'C' AS c_name, (i % 25)::INT AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 'M' AS c_mktsegment FROM range(60) r(i)",
        part="SELECT i::BIGINT AS p_partkey, 1 AS p_size FROM range(9) r(i)",
        orders="SELECT i::BIGINT AS o_orderkey, (i % 60)::BIGINT AS o_custkey FROM range(300) r(i)",
        lineitem="SELECT i::BIGINT AS l_orderkey, (i % 7 % 3 * 4)::BIGINT AS l_partkey, TIMESTAMP '2000-01-01' AS l_shipdate, 1.0::DOUBLE AS l_quantity FROM range(300) r(i) WHERE i % 60 < 40 OR i % 7 = 1",
    )
    found = QUERIES["net_partner_flags"](spark, path)
    same(found, con, SQL["net_partner_flags"])
    assert found.count() > 10 and "REPARTITION_BY_COL" in executed(found)


def test_newest_pairs_stay_where_they_arise(spark):
    """All pairs of a left row were shuffled, written and joined again before the best were taken."""
    from seamark.operators.newest import newest_join

    rows = [(i, i * 60_000_000, i % 7 / 2, i % 5 / 2) for i in range(400)]
    l, r = (spark.createDataFrame(rows, f"{s}_id long, {s}_at long, {s}_lat double, {s}_lon double") for s in "lr")
    found = newest_join(l, r, 3600, 1.5, 500)
    above = executed(found).split("SortMergeJoin")[0]
    assert found.count() > 1000 and "Window" in above and "Exchange" not in above


def test_circles_that_clients_share_are_searched_once(spark, small):
    """Every client was joined with the positions around it, though few circles differ."""
    assert "HashAggregate(keys=[flat" in executed(QUERIES["alert_subscriptions"](spark, small)).replace("knownfloatingpointnormalized(normalizenanandzero(", "")



def test_nearest_join_in_a_crowd(spark):
    """Dense and lonely rows, ties, rows at the edge of the box and of the window; all pairs of a box were sorted."""
    import math

    from seamark.operators.newest import nearest_join

    hour = 3_600_000_000
    rows = [(i, i * 37 % 100 * hour, 10 + i * 7 % 40 / 40, 10 + i * 11 % 50 / 50) for i in range(900)]
    asked = [*rows[:200], (2000, 50 * hour, 12.9, 10.5), (2001, 0, 8.0, 8.0), (2002, 50 * hour, -60.0, 0.0), (2003, 200 * hour, 10.5, 10.5)]
    left, right = (spark.createDataFrame(x, f"{s}_id long, {s}_at long, {s}_lat double, {s}_lon double") for s, x in (("l", asked), ("r", rows)))
    found = nearest_join(left, right, 30 * 3600, 2.0, 5)
    assert "Exchange" not in executed(found).split("SortMergeJoin")[0]
    got = {}
    for x in found.collect():
        got.setdefault(x["l_id"], []).append((x["km"], x["r_id"]))

    def km(a, b):
        (p, q), (s, t) = (map(math.radians, x[2:]) for x in (a, b))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2)))

    for a in asked:
        want = sorted((km(a, b), b[0]) for b in rows if abs(a[1] - b[1]) <= 30 * hour and abs(a[2] - b[2]) <= 2 and abs(a[3] - b[3]) <= 2)[:5]
        assert [round(d, 6) for d, _ in sorted(got.get(a[0], []))] == [round(d, 6) for d, _ in want]


@pytest.mark.parametrize("held", [10**7, 0])
def test_betweenness_of_long_ways(held, spark, monkeypatch):
    """Ways of more than eight hops were left out, and all pairs of nodes were shuffled: a line and a grid, by blocks and by levels."""
    from seamark.operators import graph

    monkeypatch.setattr(graph, "HELD_EDGES", held)
    plans = []
    monkeypatch.setattr(graph, "written", lambda df, real=graph.written: (plans.append(df.columns), real(df))[1])
    rows = [(i, i + 1) for i in range(1, 13)] + [(100 + 10 * y + x, 100 + 10 * (y + dy) + x + dx) for y in range(3) for x in range(4) for dy, dx in ((0, 1), (1, 0)) if y + dy < 3 and x + dx < 4] + [(5, 5), (2, 1), (None, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    near = {}
    for a, b in rows:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        order, ways, far, before = [s], {s: 1.0}, {s: 0}, {s: []}
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w], ways[w], before[w] = far[v] + 1, 0.0, []
                    order.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        back = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            want[w] += back[w]
            for v in before[w]:
                back[v] += ways[v] / ways[w] * (1 + back[w])
    nodes = spark.createDataFrame([(v,) for v in near], "node long")
    got = {r["node"]: r["centrality"] for r in graph.betweenness(edges, nodes).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert held == 0 or plans == [["a", "b"]]


@pytest.mark.parametrize(("mean", "span", "still"), [(4, 500, 0.9), (60, 6000, 0.5)])
def test_transfers_that_show_by_themselves_are_not_shuffled(mean, span, still, spark):
    """All close reports were shuffled by pair; now those of a stretch that is told at its second report, or never, are not."""
    import random

    from seamark.operators.pairs import close_reports, lasting_transfers, together, transfers, valid_positions

    r, rows = random.Random(mean), []
    for v in range(12):
        at, lat, lon = r.random() * mean, 10.2, 10.2
        while at < span:
            if r.random() > still:
                lat, lon = 10 + r.random() * 0.6, 10 + r.random() * 0.6
            rows.append((len(rows), v, int(at) * 60_000_000 if v % 2 else int(at * 60e6), None if r.random() < 0.01 else lat, lon))
            at += r.expovariate(1 / mean)
    p = spark.createDataFrame(rows, "position_id long, vessel_id long, at long, lat double, lon double")
    columns = ["a", "b", "vessel_a", "vessel_b", "began_us", "told_us", "lat", "lon"]
    plain = transfers(together(close_reports(valid_positions(p), 46.3, 6 * 3_600_000_000)), 30).select(columns)
    found = lasting_transfers(p, 46.3, 6 * 3_600_000_000, 30).select(columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() > 100
    # told in place: the first branch of the union ends in the join
    assert "Exchange" not in executed(found).split("Union")[1].split("SortMergeJoin")[0]


def test_near_join_finds_each_pair_once(spark):
    """Cells are twice the radius; the poles and 180 degrees included."""
    import math

    from seamark.operators.joins import near_join

    rows = [(i, -90 + i * 37 % 1800 / 10, -180 + i * 91 % 3600 / 10) for i in range(900)] + [(1000 + i, 89.5 + i / 20, i * 37.0 - 180) for i in range(10)] + [(2000, 10.0, 180.0), (2001, 10.0, -180.0), (2002, 10.1, 179.9)]
    left, right = (spark.createDataFrame(rows, f"{s} long, {s}_lat double, {s}_lon double") for s in "lr")

    def km(a, b):
        (p, q), (s, t) = (map(math.radians, x[1:]) for x in (a, b))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2)))

    met = near_join(left, right, 300, ("l_lat", "l_lon"), ("r_lat", "r_lon"))
    got = [(x["l"], x["r"]) for x in met.collect()]
    assert len(got) == len(set(got)) and {(a[0], b[0]) for a in rows for b in rows if km(a, b) <= 300} <= set(got)


def test_contacts_are_shuffled_by_pair_and_time_alone(spark, tables):
    """Both positions of a contact went along, to order contacts of one time, which are of one island anyway."""
    events = "SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes((i // 3 * 7)::BIGINT) AS ts, (i % 3 * 60)::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value FROM range(400) r(i)"
    path, con = tables(events=events)
    found = QUERIES["close_pairs"](spark, path)
    same(found, con, SQL["close_pairs"])
    assert found.count() > 2 and "position_id" not in executed(found).split("SortMergeJoin")[0]


def test_paths_below_the_strongest_are_given_up(spark, small, duck, monkeypatch):
    """All paths above the fixed floor were built, of which the thirty strongest were taken."""
    from seamark.plans import cascades

    floors = []
    monkeypatch.setattr(cascades, "expand_paths", lambda e, s, hops, w, floor, real=cascades.expand_paths: (floors.append((hops, floor)), real(e, s, hops, w, floor))[1])
    found = QUERIES["cartel_to_maritime"](spark, small)
    assert [h for h, _ in floors] == [1, 4] and floors[0][1] == 0.01 and floors[1][1] > 0.1
    same(found, duck, SQL["cartel_to_maritime"])


def test_few_paths_keep_the_fixed_floor(spark):
    """With fewer paths of one hop than are asked for, longer and weaker ones count."""
    from seamark.plans.cascades import strongest_ways

    edges = spark.createDataFrame([(f"e{i}", i, i + 1, 0.5) for i in range(6)], "edge_id string, src long, dst long, confidence double")
    ends = spark.range(7).withColumnRenamed("id", "event_id")
    start = spark.createDataFrame([(0,)], "root long")
    got = [(r["node"], r["score"]) for r in strongest_ways(edges, start, ends, 4, 0.1, 10).collect()]
    assert got == [(1, 0.5), (2, 0.25), (3, 0.125)]
    assert [r["node"] for r in strongest_ways(edges, start, ends, 4, 0.1, 1).collect()] == [1]


def test_similarity_of_many_pairs_at_once():
    """Each pair went through Python character by character; the results are the same to the last bit."""
    import random

    from seamark.operators.linkage import jaro_winkler, jaro_winkler_of_many

    r = random.Random(5)
    words = ["", "a", "b", "ab", "ba", "martha", "marhta", "dixon", "dicksonx", "\0", "a\0", "é€😀", "😀é"] + ["".join(r.choice("abcde é") for _ in range(r.randrange(30))) for _ in range(300)]
    pairs = [(x, y) for x in words[:40] for y in words[:40]] + [(r.choice(words), r.choice(words)) for _ in range(5000)]
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    assert jaro_winkler_of_many(a, b).tolist() == [jaro_winkler(x, y) for x, y in pairs]
    assert jaro_winkler_of_many([], []).tolist() == []
