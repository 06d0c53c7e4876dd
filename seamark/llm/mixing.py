"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of times it is taken. Rates
minimise the relative entropy to the corpus as it is, subject to one token
constraint per source and a cap. The dual of that problem is convex and splits
into one multiplier per source: a document of size ``n`` in source ``s`` has

    rate = min(cap, exp(lambda_s * n / scale_s))

(an exponential tilt), and Newton's method on the dual finds ``lambda_s``.
Documents of the same source and size share a rate, so the iterations run over
the (source, size) histogram, which Spark builds and sums.

Rates become whole copies by systematic rounding along the cells, the pairs
(source, size): the copies of a cell are the increase of the floor of the
running sum of rates. Inside a cell, where all rates are equal, every document
has the same number of copies or one more, and those with one more are the
first by a hash of the id. Rows that agree in id and text are taken alike. But
for these, the error of a source telescopes to less than its largest document. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize, passing

#: Cells are broadcast up to this many; beyond it they are joined by a shuffle.
MOST_CELLS = 200_000
#: Rates are summed as whole multiples of 2**-SCALE_BITS, so that no sum depends on its order.
SCALE_BITS = 20


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Per source: ``sid`` (its place by code point, null last), ``source_size``, ``target``.

    The sum of all sizes is shared by weight; a target stops at ``cap`` times
    its source's size and the excess is shared again by weight. With sources
    ordered by size over weight, the ones at their cap are a prefix, so one
    running sum finds the water level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight)
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("w_total", F.sum("weight").over(everyone))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.col("w_total") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
        # the level of the first source that is not full holds for all that follow
        .withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(everyone)["level"])
    )
    target = F.when(F.col("full") | F.col("final").isNull(), F.col("limit")).otherwise(F.col("final") * F.col("weight"))
    return per.select("sid", "source", "source_size", target.cast("double").alias("target"))


def tilt_multipliers(cells: DataFrame, targets: DataFrame, cap: int, tolerance: float = 1e-7, max_rounds: int = 40) -> DataFrame:
    """Newton's method on the dual: ``sid``, ``scale``, ``lam`` (null: every rate is the cap).

    ``cells`` has ``sid``, ``size``, ``n``. A step that leaves the bracket is
    replaced by bisection, so every round halves the bracket at least; rounds
    stop when no source is further than ``tolerance`` (relative) from target.
    """
    exact = "decimal(38,9)"
    stats = cells.groupBy("sid").agg(
        F.sum((F.col("n") * F.col("size")).cast(exact)).alias("s1"),
        F.sum((F.col("n") * F.col("size") * F.col("size")).cast(exact)).alias("s2"),
    )
    state = (
        targets.join(stats, "sid")
        .where("source_size > 0")
        .select(
            "sid",
            "target",
            (F.col("s2").cast("double") / F.col("s1").cast("double")).alias("scale"),
            (F.col("target") >= F.col("source_size") * (cap - 1e-9)).alias("full"),
            F.log(F.col("target") / F.col("source_size")).alias("lam"),
            F.lit(-745.0).alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            F.lit(float("inf")).alias("off"),
        )
    )
    state = materialize(state, "mix-dual")
    for _ in range(max_rounds):
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(tilt, F.lit(float(cap)))
        mass = F.col("n") * F.col("size")
        sums = (
            cells.join(state.where("not full"), "sid")
            .groupBy("sid")
            .agg(
                F.sum((mass * rate).cast(exact)).cast("double").alias("got"),
                F.sum(F.when(tilt < cap, mass * x * rate).otherwise(F.lit(0.0)).cast(exact)).cast("double").alias("slope"),
            )
        )
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        halved = F.when(F.col("hi").isNull(), F.col("lam") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = newton.isNotNull() & (newton > F.col("lo")) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton) < 700)
        state = (
            state.join(sums, "sid", "left")
            .withColumn("off", F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs(F.col("got") - F.col("target")) / F.col("target")))
            .withColumn("lo", lo)
            .withColumn("hi", hi)
            .withColumn("lam", F.when(F.col("full") | (F.col("off") <= tolerance), F.col("lam")).when(inside, newton).otherwise(halved))
            .select("sid", "target", "scale", "full", "lam", "lo", "hi", "off")
        )
        state = materialize(state, "mix-dual")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    # rounded, so that the last bits of a float sum never decide a copy
    return state.select("sid", "scale", F.when(~F.col("full"), F.round("lam", 10)).alias("lam"))


def _cell_copies(cells: DataFrame) -> DataFrame:
    """``cells`` (``sid``, ``size``, ``n``, ``rate``) with ``base``, the copies of every row, and ``extra``, the rows that have one more.

    ``rate`` is a whole number of 2**-SCALE_BITS. The running sum over all cells
    is a distributed prefix sum: each range of cells sums its own, and the
    ranges' totals shift them.
    """
    ranged = materialize(cells.repartitionByRange("sid", "size").withColumn("_part", F.spark_partition_id()), "mix-cells")
    mass = F.col("rate") * F.col("n")
    shift = ranged.groupBy("_part").agg(F.sum(mass).alias("_sum"))
    shift = shift.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_shift"))
    own = Window.partitionBy("_part").orderBy("sid", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_shift") + F.col("_upto")
    copies = F.shiftright(end, SCALE_BITS) - F.shiftright(end - mass, SCALE_BITS)
    counted = ranged.withColumn("_upto", F.sum(mass).over(own)).join(shift, "_part").withColumn("_copies", copies)
    return counted.select("sid", "size", "n", F.floor(F.col("_copies") / F.col("n")).alias("base"), F.pmod(F.col("_copies"), F.col("n")).alias("extra"))


def _last_with_extra(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``sid``, ``size``, ``last``: of each cell the key of the last row, in the order of keys, that has one copy more.

    Rows are ranked across range partitions, so that a cell with much of the
    table is split: a partition numbers its own and the partitions' counts
    shift them.
    """
    ranged = rows.select("sid", "size", "key").repartitionByRange("sid", "size", "key").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranks")
    held = ranged.groupBy("_part", "sid", "size").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("sid", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    shift = held.select("_part", "sid", "size", (F.sum("_n").over(before) - F.col("_n")).alias("_shift"))
    # the cell's last row with a copy more stands in one partition: the one whose ranks reach ``extra``
    there = shift.join(cells.where("extra > 0").select("sid", "size", "extra"), ["sid", "size"]).join(held, ["_part", "sid", "size"])
    there = there.where("_shift < extra and extra <= _shift + _n").select("_part", "sid", "size", (F.col("extra") - F.col("_shift")).alias("_at"))
    own = F.row_number().over(Window.partitionBy("_part", "sid", "size").orderBy("key"))
    return ranged.join(there, ["_part", "sid", "size"]).withColumn("_own", own).where("_own = _at").select("sid", "size", F.col("key").alias("last"))


def _key() -> Column:
    """Order of the rows of a cell: by a hash first, so that ids of one range are not all taken."""
    return F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("i"), F.col("mark").alias("m"))


def _cells(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Per source and size: ``_src``, ``_size``, ``source_size``, ``target``, ``base`` and ``last`` (see ``_cell_copies``, ``_last_with_extra``)."""
    narrow = rows.select("doc_id", "source", "size", "mark")
    sources = materialize(source_targets(narrow, weights, cap), "mix-targets").withColumnRenamed("source", "_src")
    sized = narrow.groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = materialize(sized.join(sources, F.col("source").eqNullSafe(F.col("_src"))).select("source", "sid", "size", "n", "source_size", "target"), "mix-cells")
    lam = tilt_multipliers(cells.select("sid", "size", "n"), sources.select("sid", "source_size", "target"), cap)
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(cap)))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(tilt)
    rated = cells.join(lam, "sid", "left").select("sid", "size", "n", F.round(rate * (1 << SCALE_BITS)).cast("long").alias("rate"))
    counted = materialize(_cell_copies(rated), "mix-cells")
    named = narrow.join(_small(sources.select("_src", "sid")), F.col("source").eqNullSafe(F.col("_src")))
    last = _last_with_extra(named.select("sid", "size", _key().alias("key")), counted)
    full = cells.join(counted.drop("n"), ["sid", "size"]).join(last, ["sid", "size"], "left")
    return materialize(full.select(F.col("source").alias("_src"), F.col("size").alias("_size"), "source_size", "target", "base", "last"), "mix-cells")


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= MOST_CELLS else table


def _with_copies(rows: DataFrame, cells: DataFrame) -> DataFrame:
    placed = rows.join(_small(cells), F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size")))
    more = F.when(_key() <= F.col("last"), 1).otherwise(0)
    return placed.withColumn("copies", (F.col("base") + more).cast("long"))


def _sized(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark")]


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A document's size is its number of words. No document is taken more than
    ``cap`` times. A null source is a source of its own, a null text has size
    0, and an empty document is taken 0 words. A source without words has
    target 0. Repeated rows count one by one and are taken alike. An empty table gives an empty
    result; other columns are not read.
    """
    with passing() as keep:
        rows = keep(materialize(docs.select(*_sized(id_col, text_col, source_col)), "mix-sizes"))
        cells = keep(_cells(rows, weights, cap))
    return _with_copies(rows, cells).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_to_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` takes it; its columns stay.

    Rows that are taken 0 times go, so a document without words goes. Null
    ids, texts and sources count as in ``mix``; equal rows are repeated one by
    one. ``docs`` may be any plan that gives the same rows whenever it is read,
    dealt in whatever way. An empty table gives an empty result, and no column
    name can clash.
    """
    with passing() as keep:
        cells = keep(_cells(materialize(docs.select(*_sized(id_col, text_col, source_col)), "mix-sizes"), weights, cap))
    # rows travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_sized(id_col, text_col, source_col))
    taken = _with_copies(rows, cells).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
