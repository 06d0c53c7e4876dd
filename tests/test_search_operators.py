"""Joins that look for something, communities and linkage, against plain loops."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamark.operators import linkage
from seamark.operators.asof import asof_join
from seamark.operators.communities import modularity_communities
from seamark.operators.contains import contains_join
from seamark.operators.nearest import nearest
from seamark.operators.newest import newest_join


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_nearest_at_any_distance(spark):
    rng = random.Random(2)
    right = [(i, rng.gauss(10, 1), rng.gauss(20, 1)) for i in range(200)] + [(1000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(30)]
    right += [(2000, 89.9, 0.0), (2001, -89.99, 170.0), (2002, 0.0, 179.99), (2003, 0.0, -179.98), (2004, 10.0, 20.0), (2005, 10.0, 20.0)]
    left = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [(500 + i, rng.gauss(10, 1.5), rng.gauss(20, 1.5)) for i in range(80)]
    left += [(900, 90.0, 10.0), (901, -90.0, 0.0), (902, 0.0, 180.0), (903, 0.0, -180.0), (904, 10.0, 20.0)]
    l = spark.createDataFrame([*left, (905, None, 1.0)], "id long, lat double, lon double")
    r = spark.createDataFrame([*right, (3000, None, None)], "rid long, lat double, lon double")
    got = {x["id"]: (x["nearest_id"], x["km"]) for x in nearest(l, r, "id", "rid").collect()}
    assert got.pop(905) == (None, None)
    for i, a, b in left:
        best = min((round(km(a, b, y, x), 6), k) for k, y, x in right)
        assert got[i][0] == best[1] or abs(got[i][1] - best[0]) < 2e-6, (i, got[i], best)
    assert {x["nearest_id"] for x in nearest(l, r.where("rid < 0"), "id", "rid").collect()} == {None}


@pytest.mark.parametrize("strict,width", [(False, 7), (True, 1), (True, 1000)])
def test_asof_join(spark, strict, width):
    rng = random.Random(3)
    left = [(i, rng.randrange(3) or None, rng.choice([None, *range(50)]), rng.choice([None, *range(60)])) for i in range(150)]
    right = [(i, rng.randrange(4) or None, rng.randrange(50), i) for i in range(60)]
    l, r = spark.createDataFrame(left, "id long, k long, at long, n long"), spark.createDataFrame(right, "rid long, k long, at long, n long")
    got = {x["id"]: x["hit"]["rid"] if x["hit"] else None for x in asof_join(l, r, ["k"], ["at", "n"], strict, width).collect()}
    for i, k, at, n in left:
        own = (at is not None, at or 0, n is not None, n or 0)
        later = [(t, j) for j, kk, t, m in right if kk == k and ((True, t, True, m) > own or not strict and (True, t, True, m) == own)]
        assert got[i] == (min(later)[1] if later else None)
    assert len(got) == len(left)


def test_contains_join(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(200, None), (201, ""), (202, "aaaaaaaa")]
    terms = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(300, None), (301, "aaaaa"), (302, "zzzzz"), (303, "aaaaa")]
    got = contains_join(spark.createDataFrame(terms, "t long, term string"), spark.createDataFrame(texts, "x long, body string"), "term", "body", 3)
    want = [(t, x) for t, term in terms for x, body in texts if term and body is not None and term in body]
    assert sorted((r["t"], r["x"]) for r in got.collect()) == sorted(want) and want


def test_newest_join(spark):
    rng = random.Random(5)
    hour = 3_600_000_000

    def rows(n, first):
        return [(first + i, int(rng.uniform(0, 60) * hour), *((None, None) if rng.random() < 0.1 else (rng.choice([rng.uniform(0, 3), 1.5]), rng.choice([rng.uniform(0, 3), 1.5])))) for i in range(n)]

    left, right = rows(60, 0), rows(900, 30)
    l = spark.createDataFrame(left, "l_id long, l_at long, l_lat double, l_lon double")
    r = spark.createDataFrame(right, "r_id long, r_at long, r_lat double, r_lon double")
    got = Counter((x[0], x[1]) for x in newest_join(l, r, 24 * 3600, 0.7, 5).collect())
    want = Counter()
    for i, at, y, x in left:
        met = [(t, j) for j, t, v, u in right if at - 24 * hour <= t <= at and j != i and (y is None or v is not None and abs(v - y) <= 0.7 and abs(u - x) <= 0.7)]
        want.update((i, j) for _, j in sorted(met, reverse=True)[:5])
    assert got == want and max(got.values()) == 1


def quality(edges, community):
    degree, inside = Counter(), 0
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
        inside += 2 * (community[a] == community[b])
    total = 2 * len(edges)
    sums = Counter()
    for v, d in degree.items():
        sums[community[v]] += d
    return inside / total - sum((s / total) ** 2 for s in sums.values())


def test_communities_are_as_good_as_local_search(spark):
    rng = random.Random(1)
    edges = [(a, b) for a, b in itertools.combinations(range(32), 2) if rng.random() < (0.75 if a // 8 == b // 8 else 0.04)]
    neighbours = {v: [b if a == v else a for a, b in edges if v in (a, b)] for v in range(32)}
    found = {v: v for v in range(32) if neighbours[v]}
    moved = True
    while moved:  # one node at a time
        moved = False
        for v in found:
            scores = {}
            for c in {found[v], *(found[u] for u in neighbours[v])}:
                scores[c] = quality(edges, found | {v: c})
            best = max(scores, key=lambda c: (round(scores[c], 12), c == found[v]))
            moved |= best != found[v]
            found[v] = best
    got = {r["node"]: r["community"] for r in modularity_communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert quality(edges, got) >= quality(edges, found) - 1e-9
    assert all(got[c] == c and c == min(v for v in got if got[v] == c) for c in set(got.values()))


def test_communities_of_odd_graphs(spark):
    rows = [(1, 1), (2, 3), (3, 2), (None, 4), (5, None)]
    got = {r["node"]: r["community"] for r in modularity_communities(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert modularity_communities(spark.createDataFrame([], "src long, dst long")).count() == 0


RECORDS = [(i, ["ann", "bob", "cy", "dora", None][i % 5] if i % 3 else "ann", f"z{i // 2 % 17}", None if i % 11 == 0 else str(i // 2)) for i in range(120)]


def test_block_pairs_of_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_BLOCK", 7)
    r = spark.createDataFrame(RECORDS, "id long, name string, zip string, number string")
    got = [tuple(x) for x in linkage.block_pairs(r, F.col("name"), "id").collect()]
    want = [(a[0], b[0]) for a, b in itertools.combinations(RECORDS, 2) if a[1] is not None and a[1] == b[1]]
    assert sorted(got) == sorted(want)


def test_random_pairs_are_bounded_and_distinct(spark):
    r = spark.range(5000).withColumnRenamed("id", "id")
    got = [tuple(x) for x in linkage.random_pairs(r, "id", 20_000).collect()]
    assert len(set(got)) == len(got) and 10_000 < len(got) < 40_000 and all(a < b for a, b in got)


def test_weights_as_a_plain_loop(spark):
    records = spark.createDataFrame(RECORDS, "id long, name string, zip string, number string")
    comparisons = [linkage.exact("g_name", "name", frequency=True), linkage.exact("g_zip", "zip"), linkage.exact("g_number", "number")]
    model = linkage.Model(0.01, [[0.1, 0.9], [0.2, 0.8], [0.05, 0.95]], [[0.7, 0.3], [0.9, 0.1], [0.99, 0.01]])
    pairs = linkage.candidate_pairs(records, [F.col("number"), F.col("zip")], "id")
    levels = linkage.gammas(records, pairs, comparisons, "id")
    got = {(r["l"], r["r"]): r["weight"] for r in linkage.score(records, levels, comparisons, model, 0.0).collect()}
    want = {}
    names = Counter(r[1] for r in RECORDS if r[1] is not None)
    for a, b in itertools.combinations(RECORDS, 2):
        if not (a[2] == b[2] or a[3] is not None and a[3] == b[3]):
            continue
        w = math.log2(0.01 / 0.99)
        for i, (x, y) in enumerate(zip(a[1:], b[1:])):
            if x is not None and y is not None:
                w += math.log2(model.m[i][x == y] / model.u[i][x == y])
                if i == 0 and x == y:
                    w += math.log2(model.u[0][1] / (names[x] / len(RECORDS)))
        want[a[0], b[0]] = w
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_below_the_threshold_are_not_listed(spark):
    """Records that share a common name only made the square of their number in pairs."""
    rows = [(i, "common" if i % 4 else f"n{i // 8}", f"z{i // 2 % 90}", None if i % 5 == 0 else "" if i % 7 == 0 else str(i // 3), f"{i % 50} high street") for i in range(240)]
    records = spark.createDataFrame(rows, "id long, name string, zip string, number string, address string")
    comparisons = [linkage.similar("g_name", "name", [0.9], frequency=True), linkage.exact("g_zip", "zip"), linkage.exact("g_number", "number"), linkage.distant("g_address", "address", [1, 3])]
    model = linkage.Model(0.01, [[0.1, 0.2, 0.7], [0.2, 0.8], [0.05, 0.95], [0.1, 0.1, 0.2, 0.6]], [[0.7, 0.2, 0.1], [0.9, 0.1], [0.99, 0.01], [0.7, 0.2, 0.08, 0.02]])
    blocks = [F.col("number"), F.col("name"), F.concat("zip", F.substring("name", 1, 1))]
    every, few = linkage.candidate_pairs(records, blocks, "id"), linkage.possible_pairs(records, comparisons, blocks, model, 0.7, "id")
    scored = [linkage.score(records, linkage.gammas(records, p, comparisons, "id"), comparisons, model, 0.7).collect() for p in (every, few)]
    assert sorted(scored[0]) == sorted(scored[1]) and len(scored[0]) > 20
    assert every.count() > 16_000 and few.count() < 2_000


def test_common_names_leave_their_block(spark):
    """A name that many share cannot make a match without the number, whose agreement is a block of its own."""
    records = spark.range(4000).selectExpr("id", "if(id < 3000, 'common', concat('n', id div 2)) as name", "cast(id div 2 as string) as number", "0.75D as g_name_f")
    comparisons = [linkage.exact("g_name", "name", frequency=True), linkage.exact("g_number", "number")]
    model = linkage.Model(0.001, [[0.1, 0.9], [0.05, 0.95]], [[0.7, 0.3], [0.999, 0.001]])
    bound = linkage.most_weight_of_record(comparisons, model, {"g_number"})
    assert records.where(bound >= 0).count() == 0
    assert records.where(linkage.most_weight_of_record(comparisons, model, set()) >= 0).count() == 4000


def test_sessions_fit_known_rates():
    rng = random.Random(8)
    u, m = [[0.9, 0.1], [0.8, 0.2], [0.95, 0.05]], [[0.1, 0.9], [0.3, 0.7], [0.2, 0.8]]
    table = Counter()
    for _ in range(40_000):
        row = m if rng.random() < 0.25 else u
        table[tuple(int(rng.random() < row[i][1]) for i in range(3))] += 1
    rate, fitted = linkage.fit_matches(table, u, [])
    assert abs(rate - 0.25) < 0.03 and all(abs(fitted[i][1] - m[i][1]) < 0.04 for i in range(3))
    _, skipped = linkage.fit_matches(table, u, [2])
    assert all(abs(skipped[i][1] - m[i][1]) < 0.08 for i in range(2))


def test_search_finds_what_a_full_scan_finds(spark, tmp_path):
    from seamark.operators import search as S

    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(0, 12)) + rng.choices(rare, k=rng.randint(0, 4)))) for i in range(400)] + [(1000, None), (1001, "")]
    asked = [(i, " ".join(rng.choices(common, k=3) + rng.choices(rare, k=rng.randint(0, 2)))) for i in range(25)] + [(90, None), (91, "unknown")]
    path = f"file://{tmp_path}/index"
    S.write_index(spark.createDataFrame(docs, "d long, text string"), "d", S.words(F.col("text")), path)
    got = {}
    for r in S.search(spark, path, spark.createDataFrame(asked, "q long, text string"), "q", S.words(F.col("text")), k=7).collect():
        got.setdefault(r["q"], []).append((r["place"], r["doc"], r["score"]))
    terms = {d: Counter((t or "").split()) for d, t in docs}
    df = Counter(t for c in terms.values() for t in c)
    mean = sum(c.total() for c in terms.values()) / len(docs)
    for q, text in asked:
        scores = {}
        for d, c in terms.items():
            hit = [t for t in set((text or "").split()) if t in c]
            if hit:
                scores[d] = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in hit)
        best = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:7]
        assert [d for _, d, _ in sorted(got.get(q, []))] == best
        assert all(abs(s - scores[d]) < 2e-6 for _, d, s in got.get(q, []))


def test_names_that_sound_alike_share_a_piece(spark):
    from seamark.operators.search import name_pieces

    rows = spark.createDataFrame([("Smith",), ("Smyth",), ("",), (None,), ("ab",)], "name string").select(name_pieces(F.col("name"))).collect()
    a, b, empty, null, short = (set(r[0]) for r in rows)
    assert a & b and any(x.startswith("#") for x in a & b) and not empty and not null and short == {"#A100"}


def test_risk_scores_of_known_vessels(spark):
    from seamark.functions import risk

    yes, no = F.lit(True), F.lit(None).cast("boolean")
    every = {n: F.lit(9) if isinstance(w, tuple) else yes for n, w in risk.VESSEL_WEIGHTS.items()}
    r = spark.range(1).select(
        risk.vessel_risk({n: yes for n in ("sanctioned", "risky_flag", "owner_unknown", "owner_sanctioned", "gap_last_day", "dark_transfer", "cartel_route", "near_sanctioned")}).alias("worst"),
        risk.vessel_risk({"sanctioned": F.lit(False), "near_sanctioned": no, "gaps_last_month": F.lit(None).cast("int")}).alias("clean"),
        risk.vessel_risk({"risky_flag": yes, "owner_unknown": yes}).alias("flag"),
        risk.weighted_sum(risk.VESSEL_WEIGHTS, every).alias("all"),
        risk.vessel_risk({"gaps_last_month": F.lit(40), "flag_changes": F.lit(-2)}).alias("counts"),
        risk.shell_points({n: yes for n in risk.SHELL_WEIGHTS if n != "no_staff"}, F.lit(0)).alias("shell"),
        risk.shell_points({}, F.lit(None).cast("int")).alias("half"),
    ).first()
    assert (r.worst, r.clean, r.flag, r.counts, r.shell, r.half) == (10.0, 0.0, 2.0, 1.0, 13.5, 0.5) and abs(r.all - 24.5) < 1e-9
    with pytest.raises(KeyError):
        risk.vessel_risk({"moon": yes})


def test_graph_tables_are_one_version(spark, tmp_path):
    from seamark.sinks import graph

    empty = {"vessels": "node string, mmsi string, gfw string, name string", "events": "node string, start long", "edges": "src string, dst string, kind string"}

    def step(tables, batch):
        vessels = graph.merge_nodes(tables["vessels"], batch, ["mmsi", "gfw"], ["start"], create_columns=["name"])
        met = batch.select(F.col("other").alias("mmsi"), F.lit(None).cast("string").alias("gfw"), "event", "start")
        vessels = graph.merge_nodes(vessels, met, ["mmsi"], ["start"])
        events = tables["events"].unionByName(batch.select(F.col("event").alias("node"), "start")).groupBy("node").agg(F.min("start").alias("start"))
        edges = tables["edges"].unionByName(graph.node_edges(vessels, batch, ["mmsi", "gfw"], "event", "INVOLVED_IN")).unionByName(graph.node_edges(vessels, met, ["mmsi"], "event", "ENCOUNTERED")).distinct()
        return {"vessels": vessels, "events": events, "edges": graph.with_both_ends(edges, vessels, events)[0]}

    write = graph.graph_writer(f"file://{tmp_path}/g", step, empty)
    schema = "event string, start long, mmsi string, gfw string, name string, other string"
    first = spark.createDataFrame([("e1", 1, "m1", None, "Ann", "m2"), ("e2", 2, None, "g1", "Bob", None), ("e3", 3, None, None, "no key", None)], schema)
    second = spark.createDataFrame([("e1", 9, "m1", "g1", "Other", "m3"), ("e4", 4, "m2", None, "Cy", None)], schema)
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert graph.last_version(spark, f"file://{tmp_path}/g") == 1
    read = lambda n: sorted((tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/g/version=1/{n}").collect()), key=repr)
    assert read("vessels") == sorted([("mmsi:m1", "m1", None, "Ann"), ("gfw:g1", None, "g1", "Bob"), ("mmsi:m2", "m2", None, None), ("mmsi:m3", "m3", None, None)], key=repr)
    assert read("events") == [("e1", 1), ("e2", 2), ("e3", 3), ("e4", 4)]
    assert read("edges") == sorted([("mmsi:m1", "e1", "INVOLVED_IN"), ("gfw:g1", "e2", "INVOLVED_IN"), ("mmsi:m2", "e1", "ENCOUNTERED"), ("mmsi:m3", "e1", "ENCOUNTERED"), ("mmsi:m2", "e4", "INVOLVED_IN")], key=repr)
    bad = graph.with_both_ends(spark.createDataFrame([("mmsi:m1", "e9", "x")], "src string, dst string, kind string"), spark.createDataFrame([("mmsi:m1",)], "node string"), spark.createDataFrame([("e1",)], "node string"))
    assert bad[0].count() == 0 and bad[1].count() == 1
