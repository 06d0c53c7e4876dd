"""Iterative graph algorithms on node and edge tables.

Each loop cuts its lineage with ``written()``, so that plans stay small and
a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seamark-"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder for checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table written to the folder for checkpoints.

    Spark takes the size of a checkpoint from the plan before it, where a join
    has the product of its sides: in a loop the digits of that number grow
    from round to round until the driver is busy with nothing else. A written
    table has the size of its files.
    """
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shuffled(df: DataFrame) -> DataFrame:
    """``written``, and never broadcast: files of keys are small, the rows in memory are not."""
    return written(df).hint("merge")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``node``, ``rank`` after a fixed number of power iterations; ranks sum to 1.

    The rank of nodes without out-edges is shared by all.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = _shuffled(edges.select("src", "dst").distinct())
    degree = links.groupBy("src").agg(F.count("*").alias("out"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    base = _shuffled(nodes.join(degree, F.col("node") == F.col("src"), "left").select("node", "out"))
    n = base.count()
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = ranks.agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")))).first()[0] or 0.0
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = base.join(given, F.col("node") == F.col("dst"), "left").select(
            "node", "out", ((1 - damping + damping * loose) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        ranks = _shuffled(ranks)
    return ranks.select("node", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node that each node reaches, ignoring direction."""
    ensure_checkpoint_dir(edges.sparkSession)
    both = _shuffled(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    state = _shuffled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = state.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = state.select(F.col("node").alias("t"), F.col("component").alias("tc"))
        new = _shuffled(lower.join(jump, F.col("component") == F.col("t"), "left").select("node", "was", F.least("component", F.coalesce("tc", "component")).alias("component")))
        moved = new.where("component <> was").limit(1).count()
        state = new.select("node", "component")
        if not moved:
            return state


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node``, ``community`` by synchronous label propagation.

    Each node takes the label most frequent among its neighbours and itself
    (ties: the smallest). An approximation of modularity clustering.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct()
    both = _shuffled(both.union(both.select("a", F.col("a").alias("b")).distinct()))
    state = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(state, F.col("b") == F.col("node")).groupBy("a", "community").agg(F.count("*").alias("n"))
        state = _shuffled(votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("m")).select(F.col("a").alias("node"), (-F.col("m.c")).alias("community")))
    return state


#: Edges of both directions that a task holds at most; more are joined level by level.
HELD_EDGES = 20_000_000
#: Blocks of sources for each core: a block takes a copy of the edges.
BLOCKS = 6


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``node``, ``centrality``: shortest-path dependencies summed over the given sources, ignoring direction.

    Brandes' scheme, exact for paths of any length when ``sources`` holds
    every node. The pairs of sources and nodes are never rows: sources are
    dealt to blocks, each block has the edges beside it and takes a few
    sources at a time, so that a task holds little more than the edges and
    only sums by node are shuffled. A graph of more than ``HELD_EDGES`` is
    joined level by level.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = _shuffled(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct())
    if both.count() > HELD_EDGES:
        return _betweenness_by_levels(both, sources)
    blocks = BLOCKS * spark.sparkContext.defaultParallelism
    copies = both.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "a", "b")
    # a source is told from an edge by its two equal ends
    asked = sources.where("node is not null").distinct().select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.col("node").alias("a"), F.col("node").alias("b"))
    # the number is given, as blocks are small to shuffle and long to work on
    dealt = copies.unionByName(asked).repartition(2 * blocks, "block")
    found = dealt.groupBy("block").applyInPandas(_dependencies_of_block, f"node {both.schema['a'].dataType.simpleString()}, d double")
    return found.groupBy("node").agg(F.sum("d").alias("centrality"))


def _dependencies_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """``node``, ``d``: dependencies of the sources (``a`` = ``b``) in ``rows`` on the nodes that they reach by its edges."""
    names, ends = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: len(rows)], ends[len(rows) :]
    sources, n = a[a == b], len(names)
    a, b = a[a != b], b[a != b]
    b, degree = b[np.argsort(a, kind="stable")], np.bincount(a, minlength=n)
    begin = np.cumsum(degree) - degree
    total, reached = np.zeros(n), np.zeros(n, dtype=bool)
    step = max(1, 1_000_000 // max(n, len(b), 1))
    for i in range(0, len(sources), step):
        some = sources[i : i + step]
        d, seen = dependencies(begin, degree, b, some)
        total, reached = total + d, reached | seen
    return pd.DataFrame({"node": names[reached], "d": total[reached]})


def dependencies(begin: np.ndarray, degree: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dependencies of ``sources`` on each node, summed, and which nodes they reach.

    The neighbours of node ``v`` are ``degree[v]`` of ``ends`` from ``begin[v]``
    on. All sources go out level by level together, each in a stretch of its own.
    """
    n = len(degree)
    front = np.arange(len(sources)) * n + sources
    ways, level = np.zeros(len(sources) * n), np.full(len(sources) * n, -1, dtype=np.int32)
    mark = np.zeros(len(sources) * n, dtype=np.int64)
    ways[front], level[front] = 1.0, 0
    steps = []
    while len(front):
        v = front % n
        many = degree[v]
        old = np.repeat(front, many)
        place = np.arange(len(old)) + np.repeat(begin[v] - (np.cumsum(many) - many), many)
        new = old - np.repeat(v, many) + ends[place]
        fresh = level[new] < 0
        old, new = old[fresh], new[fresh]
        np.add.at(ways, new, ways[old])
        level[new] = len(steps) + 1
        mark[new] = np.arange(len(new))
        front = new[mark[new] == np.arange(len(new))]
        steps.append((old, new))
    back = np.zeros(len(ways))
    for old, new in reversed(steps):
        np.add.at(back, old, ways[old] / ways[new] * (1 + back[new]))
    back[np.arange(len(sources)) * n + sources] = 0.0
    return back.reshape(-1, n).sum(axis=0), (level.reshape(-1, n) >= 0).any(axis=0)


def _betweenness_by_levels(both: DataFrame, sources: DataFrame) -> DataFrame:
    """``betweenness`` as joins: path counts go out from the sources, dependencies come back."""
    level = sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("sigma"))
    levels = [_shuffled(level)]
    seen = levels[0].select("s", "v")
    while True:
        step = levels[-1].join(both, F.col("v") == F.col("a")).groupBy("s", "b").agg(F.sum("sigma").alias("sigma")).withColumnRenamed("b", "v")
        new = _shuffled(step.join(seen, ["s", "v"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.union(new.select("s", "v"))
    total, later = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("d", F.lit(0.0)) if later is None else levels[k].join(later, ["s", "v"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
        here = _shuffled(here)
        total = here.select("v", "d") if total is None else total.union(here.select("v", "d"))
        back = here.join(both, F.col("v") == F.col("a")).select("s", "b", "sigma", "d")
        up = levels[k - 1].select("s", F.col("v").alias("b"), F.col("sigma").alias("up"))
        later = back.join(up, ["s", "b"]).groupBy("s", "b").agg(F.sum(F.col("up") / F.col("sigma") * (1 + F.col("d"))).alias("d")).withColumnRenamed("b", "v")
    reached = sources.select("node", F.lit(0.0).alias("d"))
    total = reached if total is None else reached.union(total.select(F.col("v").alias("node"), "d"))
    return total.groupBy("node").agg(F.sum("d").alias("centrality"))
