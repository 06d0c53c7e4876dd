"""Ship-to-ship transfers on a stream of positions.

The batch form is in ``operators/pairs.py``. Here each micro-batch adds to a
state of three tables: positions that are not settled yet or are the latest of
their vessel, pairs that are together, and the clock. Rows settle once the
newest time is ``lateness`` past them and are then taken in the order of time,
so the order of arrival does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.operators.pairs import close_reports, together, transfers, valid_positions
from seamark.tables import micros

POSITIONS = "position_id long, vessel_id long, at long, lat double, lon double"
ORDER = "struct<at:long,id:long>"
PAIRS = f"a long, b long, o {ORDER}, end {ORDER}, first struct<at:long,vessel_a:long,vessel_b:long,lat:double,lon:double>, p_id long, q_id long"
EVENTS = "a long, b long, vessel_a long, vessel_b long, began_us long, told_us long, lat double, lon double"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _last_done(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The latest batch before this one whose clock, the last table of its state, is whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    done = [int(s.getPath().getName()[6:]) for s in fs.listStatus(top)]
    return max((b for b in done if b < batch_id and _exists(spark, f"{path}/state/batch={b}/clock/_SUCCESS")), default=None)


def pair_writer(path: str, km: float = 0.5 * 1.852, minutes: int = 30, stale_minutes: int = 360, lateness_minutes: int = 10):
    """A ``foreachBatch`` function that finds transfers and appends them to ``path/events``.

    A batch has ``position_id``, ``vessel_id``, ``ts``, ``lat``, ``lon``; a
    position that comes again is taken once, one older than what has settled
    is late and left out. Pairs that part, or of which both vessels have been
    silent for ``stale_minutes``, leave the state. A batch that is run again
    overwrites what it wrote, so retries are harmless.
    """
    stale, lateness = stale_minutes * 60_000_000, lateness_minutes * 60_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _last_done(spark, path, batch_id)
        at = f"{path}/state/batch={before}"
        held = spark.createDataFrame([], POSITIONS) if before is None else spark.read.schema(POSITIONS).parquet(f"{at}/positions")
        pairs = spark.createDataFrame([], PAIRS) if before is None else spark.read.schema(PAIRS).parquet(f"{at}/pairs")
        was, newest = (None, None) if before is None else spark.read.parquet(f"{at}/clock").first()
        fresh = batch.select("position_id", "vessel_id", micros("ts").alias("at"), "lat", "lon")
        if was is not None:
            fresh = fresh.where(F.col("at") > was)
        newest = max((x for x in (newest, fresh.agg(F.max("at")).first()[0]) if x is not None), default=None)
        to, state = f"{path}/state/batch={batch_id}", held
        settled = None if newest is None else max(newest - lateness, was if was is not None else newest - lateness)
        every = held.unionByName(fresh).dropDuplicates(["position_id"])
        every.write.mode("overwrite").parquet(f"{to}/every")
        every = spark.read.schema(POSITIONS).parquet(f"{to}/every")
        if settled is None:
            state, alive, events = every, pairs, spark.createDataFrame([], EVENTS)
        else:
            valid = valid_positions(every.where(F.col("at") <= settled))
            reports = close_reports(valid, km, stale, after=was)
            # what came next for the pairs that were together
            ends = valid.select(F.col("position_id").alias("id"), "next")
            for side in ("p", "q"):
                pairs = pairs.join(ends.select(F.col("id").alias(f"{side}_id"), F.col("next").alias(f"{side}_next")), f"{side}_id", "left")
            known = pairs.withColumn("end", F.least("p_next", "q_next")).drop("p_next", "q_next")
            joined = together(reports.unionByName(known))
            joined.write.mode("overwrite").parquet(f"{to}/reports")
            joined = spark.read.parquet(f"{to}/reports")
            told = F.lit(False) if was is None else F.col("told_us") <= was
            events = transfers(joined, minutes).where(~told)
            alive = joined.where(F.col("end").isNull() & (F.col("o.at") + stale >= settled)).select("a", "b", "o", "end", F.col("began").alias("first"), "p_id", "q_id")
            last = valid.where(F.col("next").isNull() & (F.col("at") + 2 * stale >= settled)).drop("next")
            state = last.unionByName(every.where(F.col("at") > settled))
        events.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        alive.write.mode("overwrite").parquet(f"{to}/pairs")
        state.write.mode("overwrite").parquet(f"{to}/positions")
        spark.createDataFrame([(settled, newest)], "settled long, newest long").coalesce(1).write.mode("overwrite").parquet(f"{to}/clock")

    return write
