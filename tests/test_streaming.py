from datetime import datetime, timedelta

from pyspark.sql import functions as F

from seamark import tables as T
from seamark.plans.tracks import detect_gaps
from seamark.sinks.merge import table_writer
from seamark.streaming import detectors


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else query_df.sparkSession.table(name)


def test_gap_stream_equals_batch(spark, small, tmp_path):
    batch = T.positions(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).select("vessel_id", "position_id", "ts", "lat", "lon", "speed_kts", "nav_status")
    for k in range(3):  # in-order files
        batch.where((F.dayofmonth("ts") > 10 * k) & (F.dayofmonth("ts") <= 10 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.vessel_id, r.position_id) for r in run(detectors.gap_stream(stream, lateness="60 days", forget="60 days"), "gaps").collect()}
    want = {(r.vessel_id, r.position_id) for r in detect_gaps(batch).where("dayofmonth(ts) <= 30").collect()}
    assert got == want and want


def test_spikes_sessions_and_dedup(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [("a", i % 40, t0 + timedelta(seconds=i), i % 3) for i in range(120)] + [("z", 0, t0 + timedelta(days=3), 9)]
    spark.createDataFrame(rows, "source string, id long, ts timestamp, user_id long").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("source string, id long, ts timestamp, user_id long").parquet(str(tmp_path / "e"))
    spikes = run(detectors.failure_spikes(stream), "spikes").collect()
    assert spikes and all(r.source == "a" and r.n >= 100 for r in spikes)
    sessions = run(detectors.session_counts(stream), "sessions").collect()
    assert sorted((r.user_id, r.n) for r in sessions) == [(0, 40), (1, 40), (2, 40)]
    assert run(detectors.once(stream, ["source", "id"]), "once").count() == 41


def test_table_writer_is_idempotent(spark, tmp_path):
    write = table_writer(str(tmp_path / "t"), ["id"], ["ts"], ["made"])
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, made string, ts long")
    b = spark.createDataFrame([(1, "z", 3), (2, "w", 3)], "id long, made string, ts long")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/version=1")).select("id", "made", "ts").collect()} == {(1, "y", 3), (2, "w", 3)}


def test_retries(spark):
    d = spark.createDataFrame([("TIMEOUT", 2, "t"), ("TIMEOUT", 3, "t"), ("SCHEMA_VALIDATION", 0, "t"), ("TIMEOUT", None, None)], "category string, _retry_count int, _original_topic string")
    assert [(r.category, r._retry_count) for r in detectors.retries(d).collect()] == [("TIMEOUT", 3)]


def test_pair_stream_equals_batch(spark, small, tmp_path):
    import random

    from seamark.operators.pairs import close_reports, together, transfers, valid_positions
    from seamark.streaming.pairs import pair_writer
    from seamark.tables import micros

    larger = small.replace("sf0.001", "sf0.01")
    rows = T.positions(spark, larger).where("vessel_id % 60 < 20").withColumn("ts", F.col("ts").cast("timestamp")).select("position_id", "vessel_id", "ts", "lat", "lon").collect()
    last = max(r.ts for r in rows)
    rng = random.Random(11)
    late = timedelta(hours=30)
    # arrival: up to 30 hours after the time of the position, so batches overlap in time
    arrivals = sorted(((r.ts + timedelta(hours=rng.uniform(0, 29)), tuple(r)) for r in rows), key=lambda x: x[0])
    cuts = [0, len(rows) // 5, len(rows) // 5, len(rows) // 2, len(rows) - 40, len(rows)]
    batches = [[r for _, r in arrivals[a:b]] for a, b in zip(cuts, cuts[1:])]
    batches[3] += batches[2][:50]  # some come twice
    batches.append([(10**9, 10**9, last + 3 * late, 0.0, 0.0)])  # moves the clock past all
    write = pair_writer(f"file://{tmp_path}/pairs", km=25 * 1.852, stale_minutes=360, lateness_minutes=30 * 60)
    schema = "position_id long, vessel_id long, ts timestamp, lat double, lon double"
    for k, b in enumerate(batches):
        write(spark.createDataFrame(b, schema), k)
        if k in (2, 4):
            write(spark.createDataFrame(b, schema), k)  # a batch that is run again
    got = [tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/pairs/events").collect()]
    p = spark.createDataFrame(rows, schema).select("position_id", "vessel_id", micros("ts").alias("at"), "lat", "lon")
    want = [tuple(r) for r in transfers(together(close_reports(valid_positions(p), 25 * 1.852, 360 * 60_000_000)), 30).collect()]
    assert sorted(got) == sorted(want) and want


def test_pairs_as_read_one_by_one(spark):
    import random

    from seamark.operators.pairs import close_reports, together, transfers, valid_positions

    rng = random.Random(5)
    rows, t = [], 0
    for k in range(600):
        t += rng.randrange(0, 8) * 60_000_000
        v = rng.randrange(6)
        rows.append((k, v, t, 10 + rng.choice([0.0, 0.004, 0.004, 0.02]), 179.999 + rng.choice([0.0, 0.003])))
    minutes, stale, km = 30, 90 * 60_000_000, 1.0
    latest, open_pairs, want = {}, {}, []
    for k, v, at, lat, lon in rows:
        for w, (wat, wlat, wlon) in latest.items():
            if w == v:
                continue
            key = frozenset((v, w))
            a, b, c, d = map(__import__("math").radians, (lat, lon, wlat, wlon))
            m = __import__("math")
            h = m.sin((c - a) / 2) ** 2 + m.cos(a) * m.cos(c) * m.sin((d - b) / 2) ** 2
            if at - wat <= stale and 2 * 6371 * m.asin(m.sqrt(h)) <= km:
                first = open_pairs.setdefault(key, [at, v, w, False])
                if at - first[0] >= minutes * 60_000_000 and not first[3]:
                    first[3] = True
                    want.append((first[1], first[2], first[0], at))
            else:
                open_pairs.pop(key, None)
        latest[v] = (at, lat, lon)
    df = spark.createDataFrame(rows, "position_id long, vessel_id long, at long, lat double, lon double").repartition(5)
    got = transfers(together(close_reports(valid_positions(df), km, stale)), minutes).select("vessel_a", "vessel_b", "began_us", "told_us")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 3


def test_alerts_are_followed_by_silence(spark, tmp_path):
    import random

    from seamark.operators import alerts

    rng = random.Random(2)
    t0, rows, t = datetime(2026, 1, 1), [], 0
    for k in range(900):
        t += rng.choice([0, 1, 2, 3, 40]) if k % 300 < 250 else rng.choice([1, 200])
        rows.append((rng.choice("ab"), t0 + timedelta(seconds=t)))
    epoch = int((t0 - datetime(1970, 1, 1)).total_seconds())
    times, told, want = {}, {}, []
    per = sorted({(s, int((ts - t0).total_seconds()) + epoch) for s, ts in rows}, key=lambda x: x[1])
    for s, second in per:
        n = sum(r == s and second - 60 < int((ts - t0).total_seconds()) + epoch <= second for r, ts in rows)
        if n >= 8 and second - told.get(s, -(10**12)) >= 90:
            told[s] = second
            want.append((s, second, n))
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    got = alerts.after_silence(alerts.failure_counts(df.select("source", F.unix_seconds("ts").alias("second")), 8, 60), 90)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 8
    # the stream takes the same rows in another order, file by file
    order = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 50))))
    last = (max(ts for _, ts in rows), "zz")
    for k in range(6):
        spark.createDataFrame(order[k * 150 : (k + 1) * 150], "source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for k in (6, 7):
        spark.createDataFrame([("end", last[0] + timedelta(days=k))], "source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("source string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(detectors.spike_alerts(stream, 8, 60, 90, lateness="10 minutes"), "alerts")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
