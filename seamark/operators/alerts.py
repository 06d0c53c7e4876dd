"""Alerts of failing sources, each followed by a time of silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators.asof import asof_join
from seamark.operators.graph import ensure_checkpoint_dir


def failure_counts(errors: DataFrame, threshold: int, window: int) -> DataFrame:
    """``source``, ``second``, ``failures``: the seconds at which a source has ``threshold`` failures or more in the last ``window`` seconds.

    ``errors`` has ``source`` and ``second``, one row per failure; they are
    added up by second before the shuffle.
    """
    per = errors.groupBy("source", "second").agg(F.count("*").alias("n"))
    recent = Window.partitionBy("source").orderBy("second").rangeBetween(-(window - 1), 0)
    return per.select("source", "second", F.sum("n").over(recent).alias("failures")).where(F.col("failures") >= threshold)


def after_silence(spikes: DataFrame, quiet: int) -> DataFrame:
    """The rows of ``spikes`` (``source``, ``second``, ``failures``) that are told: the first of a source, then each first one ``quiet`` seconds or more after the one told last.

    A spike with none in the ``quiet`` seconds before it is told in any case.
    From these the others follow by pointers to the first spike after the
    silence, which are doubled, so that rounds grow with the logarithm of the
    longest row of alerts.
    """
    ensure_checkpoint_dir(spikes.sparkSession)
    before = F.lag("second").over(Window.partitionBy("source").orderBy("second"))
    rows = spikes.withColumn("head", F.coalesce(F.col("second") - before >= quiet, F.lit(True))).checkpoint()
    at = rows.select("source", "second", (F.col("second") + quiet).alias("t"))
    ahead = asof_join(at, rows.select("source", "second", "head", F.col("second").alias("t")), ["source"], ["t"], width=100 * quiet)
    step = ahead.where("hit is not null and not hit.head").select("source", "second", F.col("hit.second").alias("next")).checkpoint()
    told = rows.where("head").select("source", "second")
    while not step.isEmpty():
        told = told.unionByName(told.join(step, ["source", "second"]).select("source", F.col("next").alias("second"))).distinct().checkpoint()
        far = step.select("source", F.col("second").alias("next"), F.col("next").alias("far"))
        step = step.join(far, ["source", "next"]).select("source", "second", F.col("far").alias("next")).checkpoint()
    return rows.drop("head").join(told, ["source", "second"], "left_semi")
