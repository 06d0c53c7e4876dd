"""Bounded path expansion over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.operators.graph import ensure_checkpoint_dir
from seamark.operators.joins import SHUFFLED


def expand_paths(edges: DataFrame, roots: DataFrame, max_hops: int, weight: Column | None = None, floor: float | None = None, undirected: bool = False, min_hops: int = 1) -> DataFrame:
    """One row per path of ``min_hops`` to ``max_hops`` edges from each root: ``root``, ``node``, ``hops``, ``edge_ids``, ``nodes``, ``score``.

    ``edges`` has ``edge_id``, ``src``, ``dst``; ``roots`` has ``root``. Roots
    may bring the way that led to them: ``node``, ``hops``, ``edge_ids`` and
    ``score``; ``max_hops`` counts from there. A path
    uses an edge once; nodes may repeat. ``score`` is the product of
    ``weight`` (at most 1) along the path. With ``floor``, only paths above it
    stay; as products never rise, a path at or below it is given up at once.
    """
    e = edges.withColumn("_w", F.lit(1.0) if weight is None else F.least(weight, F.lit(1.0))).select("edge_id", F.col("src").alias("_from"), F.col("dst").alias("_to"), "_w")
    if undirected:
        e = e.unionByName(e.select("edge_id", F.col("_to").alias("_from"), F.col("_from").alias("_to"), "_w"))
    # few columns of a large table look small, and a broadcast would pass all edges through the driver at each hop
    e = e.hint(SHUFFLED)
    blank = {"node": F.col("root"), "hops": F.lit(0), "edge_ids": F.array().cast("array<string>"), "score": F.lit(1.0)}
    begin = {name: F.col(name) if name in roots.columns else value for name, value in blank.items()}
    level = roots.select("root", *[value.alias(name) for name, value in begin.items()], F.array(begin["node"]).alias("nodes"))
    levels = [level] if min_hops == 0 else []
    ensure_checkpoint_dir(edges.sparkSession)
    for hop in range(max_hops):
        if hop > 1:  # each level is computed once, not again under every deeper one
            level = level.checkpoint()
            levels[-1] = level
        level = level.join(e, (F.col("node") == F.col("_from")) & ~F.array_contains("edge_ids", F.col("edge_id"))).select(
            "root",
            F.col("_to").alias("node"),
            (F.col("hops") + 1).alias("hops"),
            F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"),
            F.array_append("nodes", F.col("_to")).alias("nodes"),
            (F.col("score") * F.col("_w")).alias("score"),
        )
        if floor is not None:
            level = level.where(F.col("score") > floor)
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out if min_hops <= 1 else out.where(F.col("hops") >= min_hops)


def reach(edges: DataFrame, roots: DataFrame, max_hops: int, undirected: bool = False, with_root: bool = True) -> DataFrame:
    """``root``, ``node``, ``hops``: every node within reach with its distance.

    Only first visits are expanded, so the work is bounded by pairs, not paths.
    The root itself has distance 0; without ``with_root`` it appears only where
    a cycle leads back to it, with the length of that cycle.
    """
    e = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    if undirected:
        e = e.unionByName(e.select(F.col("_to").alias("_from"), F.col("_from").alias("_to")))
    e = e.distinct().hint(SHUFFLED)
    ensure_checkpoint_dir(edges.sparkSession)
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).checkpoint()
    seen = frontier if with_root else frontier.limit(0)
    for hop in range(1, max_hops + 1):
        step = frontier.join(e, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
