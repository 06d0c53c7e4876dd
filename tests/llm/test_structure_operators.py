"""Sharding, periodic runs and conversation repair against brute force, and on awkward rows."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seamark.llm import conversation_repair as repairs
from seamark.llm import periodic_runs as runs
from seamark.llm import queries as Q
from seamark.llm import sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, pos string, arc string, shard string, slot string, part string, doc string, _row string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "p", "a", "s", "l", "q", "d", "r") for r in rows], DOCS).repartition(parts)


# --- 11 sharding


def brute_shards(rows, shards, points, slack=0.0):
    """Every row walks by itself."""

    def place(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)

    ring = {}
    for s, p in itertools.product(range(shards), range(points)):
        at = place(f"shard:{s}:{p}")
        ring[at] = min(s, ring.get(at, s))
    ats = sorted(ring)
    owner = [ring[a] for a in ats]
    room = math.ceil(len(rows) * (1 + slack))
    cap = [room // shards + (s < room % shards) for s in range(shards)]
    ready = []
    for i, t in rows:
        data = (t or "").encode()
        pos = place(f"row:{'' if i is None else i}")
        ready.append((bisect.bisect_left(ats, pos) % len(ats), pos, (i is not None, i or 0), len(data) + 8, zlib.crc32(data), i))
    ready.sort(key=lambda r: r[:5])
    load, out, stand, live = [0] * shards, [], [r[0] for r in ready], list(range(len(ready)))
    while live:
        full = [load[s] >= cap[s] for s in range(shards)]
        waiting = []
        for k in live:
            while full[owner[stand[k]]]:
                stand[k] = (stand[k] + 1) % len(ats)
            s = owner[stand[k]]
            if load[s] < cap[s]:
                arc, _, _, size, crc, i = ready[k]
                out.append((i, size, crc, s, load[s], owner[arc]))
                load[s] += 1
            else:
                waiting.append(k)
        live = waiting
    return sorted(out, key=repr)


def placed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards,points,slack", [(24, 128, 0.0), (5, 3, 0.0), (7, 16, 0.1), (1, 1, 0.0)])
def test_shards_as_brute_force(spark, small, shards, points, slack):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = placed(sharding.shard(docs, shards, points, slack))
    assert got == brute_shards(rows, shards, points, slack)


def test_shards_of_awkward_rows(spark):
    rows = [(7, "same text")] * 40 + [(None, None)] * 25 + [(8, None), (8, ""), (9, "é　x\U0001f600"), (10, "w " * 50_000), (-3, " ")] + [(k, f"t{k}") for k in range(100, 130)]
    want = brute_shards(rows, 6, 8)
    for parts in (1, 7):
        assert placed(sharding.shard(docs_of(spark, rows, parts), 6, 8)) == want
    counts = Counter(r[3] for r in want)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len({r[3] for r in want if r[0] == 7}) > 1  # a hot key is spread
    for s in counts:
        assert sorted(r[4] for r in want if r[3] == s) == list(range(counts[s]))


def test_shards_move_little(spark):
    rows = [(k, "") for k in range(4000)]
    at = {n: {r[0]: r[3] for r in brute_shards(rows, n, 128, 0.05)} for n in (24, 25)}
    moved = sum(at[24][k] != at[25][k] for k in at[24]) / len(rows)
    assert moved < 0.08  # one in 25 has to


def test_empty_shards(spark):
    assert sharding.shard(docs_of(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def test_shards_refuse_bad_settings(spark):
    for bad in ((0, 1, 0.0), (1, 0, 0.0), (1, 1, -0.1)):
        with pytest.raises(ValueError):
            sharding.shard(docs_of(spark, [(1, "a")]), *bad)


def test_written_shards(spark, tmp_path):
    rows = [(k % 50, f"text {k % 20}") for k in range(200)]
    sharding.write_shards(docs_of(spark, rows), f"file://{tmp_path}/s", 4, 8)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    got = sorted((r["doc"]["doc_id"], r["doc"]["text"], r["doc"]["shard"], r["shard"], r["slot"]) for r in back.collect())
    assert Counter(g[:2] for g in got) == Counter(rows) and {g[2] for g in got} == {"s"}
    assert sorted(g[3:] for g in got) == [(s, k) for s in range(4) for k in range(50)]


# --- 12 periodic runs


def brute_lyndon(x):
    out = []
    for i in range(len(x)):
        out.append(max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))))
    return out


def brute_runs(x, least_length, least_exponent):
    found = {}
    for q in range(1, len(x) // least_exponent + 1):
        i = 0
        while i + q < len(x):
            begin = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - begin + q >= max(least_length, least_exponent * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin or i + q < len(x)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    x = []
    while len(x) < rng.randint(4, 60):
        if rng.random() < 0.6:
            root = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]
            x += (root * 8)[: rng.randint(3, 40)]
        else:
            x += [rng.randrange(4) for _ in range(rng.randint(1, 6))]
    return x


def test_lyndon_lengths():
    rng = random.Random(5)
    for _ in range(800):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 20))]
        assert runs.lyndon_lengths(x) == brute_lyndon(x), x


@pytest.mark.parametrize("least_length,least_exponent", [(6, 4), (2, 2), (6, 3), (1 << 3, 5)])
def test_word_runs(least_length, least_exponent):
    rng = random.Random(6)
    for _ in range(800):
        x = repetitive(rng)
        assert runs.word_runs([b"%d" % c for c in x], least_length, least_exponent) == brute_runs(x, least_length, least_exponent), x


def test_runs_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr(runs, "_powers", lambda n: np.zeros(n, np.uint64))  # every hash agrees
    rng = random.Random(7)
    for _ in range(200):
        x = repetitive(rng)
        got = runs.word_runs([b"%d" % c for c in x], 6, 4)
        assert all(r in brute_runs(x, 6, 4) for r in got)
        assert len(got) == len(set(got))


def test_thue_morse_has_no_runs_and_fibonacci_no_fourth_powers():
    t = [bin(i).count("1") % 2 for i in range(4096)]
    assert runs.word_runs([b"%d" % c for c in t], 6, 3) == []
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs.word_runs([b"%d" % c for c in b], 6, 4) == []
    assert runs.word_runs([b"%d" % c for c in b], 6, 3) == brute_runs(b, 6, 3)


def test_long_texts_take_linear_time():
    assert runs.word_runs([b"x"] * 300_000, 6, 4) == [(0, 300_000, 1)]
    assert runs.word_runs([b"%d" % (i % 331) for i in range(300_000)], 6, 4) == [(0, 300_000, 331)]


def test_find_runs_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a\x0ba\ta\na a  a"), (5, "a a a a a"), (5, "a a a a a"), (None, "x " + "b c " * 5), (6, "é　 " * 6), (7, "q r " * 300)]
    got = sorted(((r[0], [tuple(x) for x in r[1]], r[2]) for r in runs.find_runs(docs_of(spark, rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        found = brute_runs(words, 6, 4)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i, found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)


def test_op12_as_brute_force(spark, small):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, small).collect()}
    assert set(got) == set(docs)
    planted = 0
    for d, t in docs.items():
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1500:
            continue
        found = brute_runs(w, 6, 4)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[d] == (len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), d
    assert planted > 5


def test_runs_of_an_empty_table(spark):
    assert runs.find_runs(docs_of(spark, [(1, "a")]).where("doc_id > 1")).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs_of(spark, [(1, "a")]), least_exponent=1)


# --- 13 conversation repair

TURNS = "conv_id long, turn long, role string, text string, conv string, seq string, action string, fault string"


def turns_of(spark, rows, parts=2):
    return spark.createDataFrame([(*r, "c", "s", "a", "f") for r in rows], TURNS).repartition(parts)


def brute_repair(rows):
    """All edits of up to two inserted turns in a gap: (cost, audit, lines) of the least that gives the grammar. ``rows``: (role, text) in order."""
    marked, seen = [], set()
    for role, text in rows:
        body = text.rstrip(repairs.ASCII_SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"], ["user", "user"], ["assistant", "assistant"]]
    best = None

    def walk(at, cost, audit, lines, roles):
        nonlocal best
        for gap in gaps:
            c, a, ls, rs = cost + 3 * len(gap), audit + "I" * len(gap), lines + [f"{r}:" for r in gap], roles + "".join(r[0] for r in gap)
            if best and c > best[0] or not re.match(r"s?(ua)*u?\Z", rs):
                continue
            if at == len(marked):
                if re.match(r"(s?(ua)+)?\Z", rs) and (best is None or (c, a) < best[:2]):
                    best = (c, a, ls)
                continue
            role, text, fault = marked[at]
            more = 3 if fault == "truncated" else 0
            walk(at + 1, c + 4, a + "D", ls, rs)
            if fault in (None, "truncated"):
                walk(at + 1, c + more, a + "K", [*ls, f"{role}:{text}"], rs + (role[:1] or "?"))
                for r in ("user", "assistant"):
                    walk(at + 1, c + 3 + more, a + "R", [*ls, f"{r}:{text}"], rs + r[0])

    walk(0, 0, "", [], "")
    counts = Counter(f for _, _, f in marked)
    return best, (counts["blank"], counts["duplicate"], counts["truncated"])


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "upper"]
    return [(rng.choices(roles, (6, 6, 2, 1, 1, 1))[0], rng.choice(["Yes.", "No!", "What", " ", "", "So?\n", "Cut off", "One. Two"])) for _ in range(n)]


def digests(spark, rows):
    turns = turns_of(spark, rows)
    return {r["conv_id"]: r for r in repairs.digest(repairs.repair(turns), turns).collect()}


def test_repair_as_brute_force(spark):
    rng = random.Random(9)
    convs = {c: random_turns(rng, rng.randint(1, 5)) for c in range(150)}
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    got = digests(spark, rows)
    for c, turns in convs.items():
        (cost, audit, lines), counts = brute_repair(turns)
        r = got[c]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), (turns, lines)
        assert (r["blank"], r["duplicate"], r["truncated"]) == counts
        assert r["illegal"] == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(turns))


def test_repair_of_awkward_rows(spark):
    rows = [(1, None, "assistant", "First."), (1, 5, "user", "Second."), (1, 5, "user", "Second."), (1, 9, None, None), (None, 1, "user", "Alone."), (2, None, "user", "A."), (2, 3, "assistant", "B.")]
    got = digests(spark, rows)
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["illegal"]) == (3, 1, 1, 2)
    assert got[None]["audit"] == "KI" and got[None]["cost"] == 3
    assert got[2]["audit"] == "KK" and got[2]["gaps"] == 0


def test_long_conversation_is_streamed(spark):
    rng = random.Random(3)
    turns = [(("user", "assistant")[k % 2], f"Text {k}.") for k in range(6000)]
    broken = [t for t in turns if rng.random() > 0.05]
    repair = repairs.Repair(repairs.Stacks(repairs.Tables(repairs.ROLE_GRAMMAR)), repairs.Prices())
    most = 0
    for role, _ in broken:
        repair.row(role[0], False, False)
        most = max(most, max(len(a) for _, a, _ in repair.tops.values()))
        if repair.undecided() >= repairs.OPEN_EDITS:
            repair.agreed()
    assert most < 20 * repairs.OPEN_EDITS
    got = digests(spark, [(1, k, *t) for k, t in enumerate(broken)])[1]
    assert got["audit"].count("D") + got["audit"].count("K") + got["audit"].count("R") == len(broken)
    assert got["cost"] == 3 * (got["audit"].count("I") + got["audit"].count("R")) + 4 * got["audit"].count("D")


def test_conversations_that_lose_all_rows(spark):
    rows = [(c, t, "user", "x.") for c in range(60) for t in range(1)]
    turns = turns_of(spark, rows)
    got = {r["conv_id"]: r for r in repairs.digest(repairs.repair(repairs.damage(turns)), turns).collect()}
    gone = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(got) == 60 and gone
    for c in gone:
        assert got[c]["audit"] == "" and got[c]["cost"] == 0 and got[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repair_of_an_empty_table(spark):
    assert repairs.repair(turns_of(spark, [(1, 1, "user", "x")]).where("turn > 1")).count() == 0


def test_grammar_tables_refuse_conflicts():
    with pytest.raises(ValueError):
        repairs.Tables((("s", ("x",)), ("s", ("x", "x")), ("s", ("s", "s"))))


@pytest.mark.parametrize("name", ["op11_sharding", "op13_conversation_repair"])
def test_awkward_tables_as_sql(name, spark, tmp_path):
    import duckdb
    from compare import same

    docs = [(None, None), (3, ""), (3, ""), (4, "é x"), (5, "a b"), (6, None)] + [(k, f"t {k}") for k in range(40)]
    docs_of(spark, docs).select("doc_id", "text").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    rng = random.Random(4)
    turns = [(c, k or None, role, text) for c in range(40) for k, (role, text) in enumerate(random_turns(rng, 6))] + [(None, 1, None, None), (None, 2, "user", "Yes.")]
    turns_of(spark, turns).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same(Q.QUERIES[name](spark, f"file://{tmp_path}"), con, Q.ORACLE_SQL[name])
