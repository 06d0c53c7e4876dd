"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` places on a ring, by a hash of its number; a row
stands where the hash of its key falls and belongs to the next place clockwise.
No shard takes more rows than its capacity: rows that find it full continue
clockwise to the next place of a shard that has room. With no slack the
capacities add up to the number of rows, so row counts are at most one apart;
with slack the counts may differ by as much, and fewer rows move when rows or
shards are added.

The rows between two places of the ring (an arc) go the same way, so the walk
is done on the number of rows of each arc, a table as long as the ring whatever
the input. It takes rounds: all waiting rows of all arcs walk to their next
open shard, and each shard takes them in the order of the ring until it is
full. A round in which rows are left over fills a shard, so there are no more
rounds than shards. Only the order of rows inside an arc needs the rows
themselves: they are sorted across range partitions by place, key, size and
checksum, and then by a number of their own, so that a key that holds much of
the table is split. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize, numbered, passing

#: Places of the ring are below 2**RING_BITS.
RING_BITS = 60


def place(key: Column) -> Column:
    """Where the string ``key`` falls on the ring: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, RING_BITS // 4), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """``arc``, ``at``, ``shard``: the places of all shards, numbered clockwise from 0.

    As long as ``shards * points`` at most, so one task numbers it. Of two
    shards with the same place the smaller number has it.
    """
    k = F.col("id")
    number = F.floor(k / points).cast("int")
    name = F.concat(F.lit("shard:"), number.cast("string"), F.lit(":"), (k % points).cast("string"))
    places = spark.range(shards * points).select(place(name).alias("at"), number.alias("shard")).groupBy("at").agg(F.min("shard").alias("shard"))
    return places.coalesce(1).select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("arc"), "at", "shard")


def _cells(places: DataFrame, bits: int) -> DataFrame:
    """The ring cut into ``2**bits`` equal cells: ``cell``, the places in it in order, and ``beyond``, the first arc after it."""
    spark = places.sparkSession
    own = places.groupBy(F.shiftright("at", RING_BITS - bits).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("at", "arc"))).alias("near"))
    full = spark.range(1 << bits).withColumnRenamed("id", "cell").join(own, "cell", "left").coalesce(1)
    after = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return full.select("cell", "near", F.coalesce(F.last(F.col("near")[0]["arc"], ignorenulls=True).over(after), F.lit(0)).alias("beyond"))


def _with_arc(rows: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """``rows`` (with ``pos``) and the arc of each: that of the first place at or after it."""
    bits = min(20, max(4, count.bit_length()))
    cells = F.broadcast(_cells(places, bits))  # at most 2**20 rows, by the ring alone
    met = rows.withColumn("cell", F.shiftright("pos", RING_BITS - bits)).join(cells, "cell")
    pos = F.col("pos")
    first = F.try_element_at(F.filter("near", lambda p: p["at"] >= pos), F.lit(1))["arc"]
    return met.withColumn("arc", F.coalesce(first, "beyond")).drop("cell", "near", "beyond")


def _capacities(spark: SparkSession, shards: int, total: int, slack: float) -> DataFrame:
    """``shard``, ``cap``: ``(1 + slack) * total`` rows, rounded up, as evenly as whole numbers go."""
    room = max(total, -int(-(total * (1 + slack)) // 1))
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(room // shards) + F.when(F.col("id") < room % shards, 1).otherwise(0)).alias("cap"))


def bounded_walk(counts: DataFrame, places: DataFrame, caps: DataFrame) -> DataFrame:
    """Which rows of an arc go where: ``arc``, ``first``, ``n``, ``shard``, ``base``.

    ``counts`` has the number ``n`` of the rows of each ``arc``. Rows ``first``
    to ``first + n - 1`` of the arc take the slots from ``base`` on in ``shard``.
    All tables are as long as the ring, so one task does a round.
    """
    waiting = counts.where("n > 0").select("arc", F.col("arc").alias("stand"), F.lit(0).cast("long").alias("first"), "n")
    done: list[DataFrame] = []
    while True:
        fill = caps.withColumn("used", F.lit(0).cast("long"))
        if done:
            taken = done[0]
            for d in done[1:]:
                taken = taken.unionByName(d)
            fill = caps.join(taken.groupBy("shard").agg(F.sum("take").alias("took")), "shard", "left").select("shard", "cap", F.coalesce("took", F.lit(0)).cast("long").alias("used"))
        there = F.when(F.col("used") < F.col("cap"), F.struct("arc", "shard", "cap", "used"))
        back = Window.orderBy(F.col("arc").desc()).rowsBetween(Window.unboundedPreceding, 0)
        everywhere = Window.partitionBy(F.lit(0))
        ahead = places.join(F.broadcast(fill.coalesce(1)), "shard").coalesce(1).select(F.col("arc").alias("stand"), F.coalesce(F.last(there, ignorenulls=True).over(back), F.min(there).over(everywhere)).alias("to"))
        offers = waiting.join(F.broadcast(ahead), "stand").coalesce(1).select("arc", "first", "n", F.col("to.arc").alias("stand"), F.col("to.shard").alias("shard"), F.col("to.cap").alias("cap"), F.col("to.used").alias("used"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("arc")) - F.col("n")
        took = F.greatest(F.lit(0), F.least(F.col("n"), F.col("cap") - F.col("used") - before)).cast("long")
        offers = materialize(offers.select("*", took.alias("take"), (F.col("used") + before).alias("base")), "ring-round")
        done.append(offers.where("take > 0").select("arc", "first", "take", "shard", "base"))
        waiting = offers.where("take < n").select("arc", "stand", (F.col("first") + F.col("take")).alias("first"), (F.col("n") - F.col("take")).alias("n"))
        if waiting.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out.withColumnRenamed("take", "n")


def _assign(docs: DataFrame, shards: int, points: int, slack: float, id_col: str, text_col: str, whole: bool) -> DataFrame:
    if shards < 1 or points < 1 or slack < 0:
        raise ValueError("shards and points must be at least 1, slack not negative")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit("row:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    columns = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(key).alias("pos")]
    if whole:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    with passing() as keep:
        rows = numbered(docs, columns, "ring-rows")
        places = keep(materialize(ring(spark, shards, points), "ring-places"))
        order = ["arc", "pos", "doc_id", "size", "text_crc32", "_row"]
        sorted_rows = _with_arc(rows, places, shards * points).repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_rows = keep(materialize(sorted_rows.select(F.monotonically_increasing_id().alias("n_at"), *[c for c in ("arc", "doc_id", "size", "text_crc32", "doc") if c != "doc" or whole]), "ring-sorted"))
        part = F.shiftright("n_at", 33).alias("part")
        # a range partition holds whole arcs but for its ends: as many stretches as arcs and partitions together
        stretches = sorted_rows.groupBy(part, "arc").agg(F.min("n_at").alias("at"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("arc").orderBy("part"))
        stretches = materialize(stretches.select("part", "arc", "at", "n", (upto - F.col("n")).alias("rank")), "ring-stretches")
        counts = materialize(stretches.groupBy("arc").agg(F.sum("n").alias("n")).coalesce(1), "ring-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        walk = bounded_walk(counts, places, _capacities(spark, shards, total, slack))
        pieces = walk.select(F.col("arc").alias("arc_"), "first", F.col("n").alias("n_"), "shard", "base")
        lo, hi = F.greatest("rank", "first"), F.least(F.col("rank") + F.col("n"), F.col("first") + F.col("n_"))
        cut = stretches.join(F.broadcast(pieces), F.col("arc") == F.col("arc_")).where(lo < hi)
        start = F.col("at") + lo - F.col("rank")
        homes = places.select(F.col("arc").alias("arc_"), F.col("shard").alias("home_shard"))
        cut = cut.select(F.col("part").alias("part_"), F.col("arc").alias("arc_"), start.alias("start"), (start + hi - lo).alias("stop"), "shard", (F.col("base") + lo - F.col("first") - start).alias("shift"))
        cut = keep(materialize(cut.join(F.broadcast(homes), "arc_"), "ring-cuts"))
    # as long as the ring and the partitions of the sort together
    met = sorted_rows.join(F.broadcast(cut), (part == F.col("part_")) & (F.col("arc") == F.col("arc_")) & (F.col("n_at") >= F.col("start")) & (F.col("n_at") < F.col("stop")))
    return met.withColumn("slot", F.col("n_at") + F.col("shift"))


def shard(docs: DataFrame, shards: int = 24, points: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``home_shard``.

    ``size`` is the UTF-8 length of the text and 8 more, ``slot`` numbers the
    rows of a shard without gaps from 0, and ``home_shard`` is the shard that
    the row would have on a ring without bounds. A shard holds at most its
    share of ``(1 + slack)`` times all rows; without slack the shards' row
    counts differ by one at most. Repeated rows and rows with the same id
    stand at one place of the ring and are spread clockwise like others; a
    null id stands where the empty string does, a null text is empty. Reruns
    agree, however the rows are dealt. An empty table gives an empty result;
    other columns are not read.
    """
    return _assign(docs, shards, points, slack, id_col, text_col, False).select("doc_id", "size", "text_crc32", "shard", "slot", "home_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, points: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs``, as the struct ``doc`` with ``slot``, as Parquet in a folder for each shard.

    Cases are as in ``shard``; no column name can clash. A shard without rows has no folder.
    """
    placed = _assign(docs, shards, points, slack, id_col, text_col, True)
    placed.select("doc", "slot", "shard").write.partitionBy("shard").parquet(path)


def oracle(shards: int, points: int) -> str:
    """SQL of ``shard`` on ``documents`` without slack: rows instead of arcs walk the ring, round by round."""
    return rf"""
        WITH RECURSIVE
        tab AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
        ring AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY spot) - 1 AS arc, spot, shard FROM (
                SELECT ('0x' || substr(md5('shard:' || s || ':' || p), 1, 15))::BIGINT AS spot, min(s) AS shard
                FROM range({shards}) AS a(s), range({points}) AS b(p) GROUP BY spot)),
        texts AS MATERIALIZED (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, ('0x' || substr(md5('row:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos FROM documents),
        sums AS MATERIALIZED (
            SELECT doc_id, pos, length(h) // 2 + 8 AS size,
                   xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, tab),
        docs AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY coalesce(arc, 0), pos, doc_id NULLS FIRST, size, text_crc32) AS k, doc_id, size, text_crc32, coalesce(arc, 0) AS arc
            FROM sums ASOF LEFT JOIN ring ON sums.pos <= ring.spot),
        caps AS MATERIALIZED (SELECT s AS shard, n // {shards} + (s < n % {shards})::INT AS cap FROM range({shards}) AS a(s), (SELECT count(*) AS n FROM docs)),
        walk AS (
            SELECT 0 AS step, k, arc AS stand, NULL::BIGINT AS shard, NULL::BIGINT AS slot FROM docs
            UNION ALL
            SELECT step + 1, k, coalesce(to_arc, stand), CASE WHEN shard IS NOT NULL THEN shard WHEN used + place <= cap THEN to_shard END,
                   CASE WHEN shard IS NOT NULL THEN slot WHEN used + place <= cap THEN used + place - 1 END
            FROM (
                SELECT w.*, o.to_arc, r.shard AS to_shard, c.cap, coalesce(u.n, 0) AS used,
                       row_number() OVER (PARTITION BY r.shard, w.shard IS NULL ORDER BY k) AS place
                FROM walk AS w
                JOIN (SELECT ring.arc, coalesce(min(CASE WHEN coalesce(n, 0) < cap THEN ring.arc END) OVER (ORDER BY ring.arc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                                                min(CASE WHEN coalesce(n, 0) < cap THEN ring.arc END) OVER ()) AS to_arc
                      FROM ring JOIN caps ON ring.shard = caps.shard
                      LEFT JOIN (SELECT shard, count(*) AS n FROM walk WHERE shard IS NOT NULL GROUP BY shard) AS f ON f.shard = ring.shard) AS o ON o.arc = w.stand
                JOIN ring AS r ON r.arc = o.to_arc JOIN caps AS c ON c.shard = r.shard
                LEFT JOIN (SELECT shard, count(*) AS n FROM walk WHERE shard IS NOT NULL GROUP BY shard) AS u ON u.shard = r.shard)
            WHERE (SELECT count(*) FROM walk WHERE shard IS NULL) > 0)
        SELECT doc_id, size, text_crc32, 'rows' AS law, walk.shard::INT AS shard, slot, NULL::INT AS grown_shard, ring.shard::INT AS home_shard
        FROM walk JOIN docs ON docs.k = walk.k JOIN ring ON ring.arc = docs.arc WHERE step = (SELECT max(step) FROM walk)
    """
